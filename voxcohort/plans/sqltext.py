"""SQL text shared by several statements: AUC by midranks, log loss, unrolled Newton fits."""

from __future__ import annotations


def auc_sql(source: str, keys: list[str], score: str, y: str = "y", alias: str = "auc") -> str:
    part = f"partition by {', '.join(keys)}" if keys else ""
    tie = f"partition by {', '.join(keys + [score])}"
    head = "".join(f"{k}, " for k in keys)
    group = f"group by {', '.join(keys)}" if keys else ""
    return f"""(select {head}case when count(*) filter (where {y} = 1) * count(*) filter (where {y} = 0) > 0 then
      (sum(case when {y} = 1 then mr end) - count(*) filter (where {y} = 1) * (count(*) filter (where {y} = 1) + 1) / 2.0::double)
      / (cast(count(*) filter (where {y} = 1) as double) * count(*) filter (where {y} = 0)) end {alias}
      from (select *, rank() over ({part} order by {score}) + (count(*) over ({tie}) - 1) / 2.0::double mr from {source}) {group})"""


def clip(p: str) -> str:
    return f"greatest(1e-6::double, least(1 - 1e-6::double, {p}))"


def logit(p: str) -> str:
    return f"ln({clip(p)} / (1 - {clip(p)}))"


def sig(z: str) -> str:
    return f"(1 / (1 + exp(-({z}))))"


def ll(p: str, y: str = "y") -> str:
    c = clip(p)
    return f"avg(-({y}*ln({c}) + (1 - {y})*ln(1 - {c})))"


def bce(z: str, y: str = "y") -> str:
    return f"(greatest({z}, 0) - ({z})*{y} + ln(1 + exp(-abs({z}))))"


def newton(source: str, name: str, a: str | None = None, b: str | None = None, group: str | None = None, steps: int = 14) -> str:
    """CTEs `<name>0 .. <name>N`; the last one is also `<name>`. `a`/`b` pin a parameter."""
    g = f"{group}, " if group else ""
    using = f"join {{prev}} using ({group})" if group else "cross join {prev}"
    by = f"group by {group}" if group else ""
    start = f"select distinct {g}{a or '1.0::double'} a, {b or '0.0::double'} b from {source}"
    ctes = [f"{name}0 as materialized ({start})"]
    for i in range(1, steps + 1):
        prev = f"{name}{i - 1}"
        if a is None and b is None:
            na = "max(a) - (sum(h)*sum(g*z) - sum(h*z)*sum(g)) / (sum(h*z*z)*sum(h) - sum(h*z)*sum(h*z))"
            nb = "max(b) - (sum(h*z*z)*sum(g) - sum(h*z)*sum(g*z)) / (sum(h*z*z)*sum(h) - sum(h*z)*sum(h*z))"
        elif a is None:
            na, nb = "max(a) - sum(g*z) / sum(h*z*z)", "max(b)"
        else:
            na, nb = "max(a)", "max(b) - sum(g) / sum(h)"
        ctes.append(
            f"{name}{i} as materialized (select {g}{na} a, {nb} b from (select *, p - y g, p*(1-p) h from "
            f"(select *, 1/(1+exp(-(a*z+b))) p from {source} {using.format(prev=prev)})) {by})"
        )
    ctes.append(f"{name} as (select * from {name}{steps})")
    return ",\n".join(ctes)


def settled(name: str, steps: int = 14, group: str | None = None) -> str:
    """Whether the last step of newton() was below rounding: an expression, or per group a scalar subquery over column `group` of the outer row."""
    a, b = f"{name}{steps}", f"{name}{steps - 1}"
    on = f"p.{group} = q.{group}" if group else "true"
    return f"(select bool_and(abs(p.a - q.a) <= 1e-7*(1 + abs(q.a)) and abs(p.b - q.b) <= 1e-7*(1 + abs(q.b))) from {a} p join {b} q on {on})"


def logistic_sql(source: str, name: str, features: list[str], y: str = "y", ridge: float = 1e-3, steps: int = 8) -> str:
    """CTEs: `<name>` (fit, model, b0 ..) are ridge logistic models per fit and held-out fold of source (fit, fold, y and features), by Newton steps
    whose normal equations are solved by elimination."""
    d = len(features) + 1
    xs = ["1.0::double", *features]
    z = " + ".join(f"b{i}*{x}" for i, x in enumerate(xs))
    cols = [f"a{i}_{j}" for i in range(d) for j in range(i, d)] + [f"r{i}" for i in range(d)]
    keep = ", ".join(["fit", "model", *(f"b{i}" for i in range(d))])
    out = [f"{name}_0 as materialized (select distinct fit, fold model, {', '.join(f'0.0::double b{i}' for i in range(d))} from {source})"]
    for s in range(1, steps + 1):
        g = [f"sum((y - p)*{x}) - {ridge!r}::double*max(b{i}) r{i}" for i, x in enumerate(xs)]
        h = [f"sum(p*(1 - p)*{xs[i]}*{xs[j]}){f' + {ridge!r}::double' if i == j else ''} a{i}_{j}" for i in range(d) for j in range(i, d)]
        b = ", ".join(f"max(b{i}) b{i}" for i in range(d))
        prev = f"{name}_{s}_s"
        out.append(f"{prev} as materialized (select fit, model, {b}, {', '.join(h + g)} from (select t.fit, m.model, {y} y, {', '.join(features)}, {', '.join(f'b{i}' for i in range(d))}, 1/(1 + exp(-({z}))) p from {source} t join {name}_{s - 1} m on t.fit = m.fit and t.fold <> m.model) group by fit, model)")
        for k in range(d - 1):
            at = lambda i, j: f"a{min(i, j)}_{max(i, j)}"
            new = [f"a{i}_{j} - {at(k, i)}*{at(k, j)}/a{k}_{k} a{i}_{j}" if i > k else f"a{i}_{j}" for i in range(d) for j in range(i, d)]
            new += [f"r{i} - {at(k, i)}*r{k}/a{k}_{k} r{i}" if i > k else f"r{i}" for i in range(d)]
            out.append(f"{name}_{s}_{k} as (select {keep}, {', '.join(new)} from {prev})")
            prev = f"{name}_{s}_{k}"
        for i in range(d - 1, -1, -1):
            rest = " - ".join(["r" + str(i), *(f"a{i}_{j}*x{j}" for j in range(i + 1, d))])
            out.append(f"{name}_{s}_x{i} as (select *, ({rest})/a{i}_{i} x{i} from {prev})")
            prev = f"{name}_{s}_x{i}"
        out.append(f"{name}_{s} as materialized (select fit, model, {', '.join(f'b{i} + x{i} b{i}' for i in range(d))} from {prev})")
    out.append(f"{name} as (select * from {name}_{steps})")
    return ",\n".join(out)


def smooth_sql(source: str, name: str, sizes: dict[str, int], weights: list[float], border: str = "zero", value: str = "v", extra: str = "", only: list[str] | None = None) -> str:
    """CTEs smoothing `value` of `source` axis by axis; the result is `name`."""
    half = len(weights) // 2
    vals = ", ".join(f"({d}, {w!r}::double)" for d, w in zip(range(-half, half + 1), weights))
    keys = ["uid", *([extra] if extra else []), *sizes]
    prev, ctes = source, []
    for k, ax in enumerate(only or list(sizes)):
        cur = f"{name}_{k}"
        others = " and ".join(f"a.{o} = b.{o}" for o in keys if o != ax)
        at = f"a.{ax} + k.d"
        if border == "replicate":
            at = f"greatest(0, least({sizes[ax] - 1}, {at}))"
        ctes.append(
            f"{cur} as (select {', '.join('a.' + c for c in keys)}, sum(k.w * b.{value}) {value} from {prev} a cross join (values {vals}) k(d, w) "
            f"join {prev} b on {others} and b.{ax} = {at} group by {', '.join('a.' + c for c in keys)})"
        )
        prev = cur
    ctes.append(f"{name} as (select * from {prev})")
    return ",\n".join(ctes)


def components_sql(mask: str, name: str, axes: dict[str, int]) -> str:
    """CTEs labelling `mask` (uid and axes) by face connectivity; `<name>` has label, `<name>_big` the largest."""
    cell = "0"
    for a, n in axes.items():
        cell = f"({cell})*{n} + {a}"
    dist = " + ".join(f"abs(a.{a} - b.{a})" for a in axes)
    cols = ", ".join(axes)
    return f"""{name}_m as (select uid, {cols}, {cell} c from {mask}),
    {name}_e as (select a.uid, a.c a, b.c b from {name}_m a join {name}_m b on a.uid = b.uid and {dist} = 1),
    {name}_r(uid, a, b) as (select uid, c, c from {name}_m union select r.uid, r.a, e.b from {name}_r r join {name}_e e on r.uid = e.uid and r.b = e.a),
    {name} as (select m.uid, {', '.join('m.' + a for a in axes)}, r.label from {name}_m m join (select uid, a, min(b) label from {name}_r group by 1, 2) r on m.uid = r.uid and m.c = r.a),
    {name}_big as (select l.* from {name} l join (select uid, label, row_number() over (partition by uid order by count(*) desc, label) k from {name} group by 1, 2) b on l.uid = b.uid and l.label = b.label and b.k = 1)"""
