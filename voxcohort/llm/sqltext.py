"""SQL that states results of document queries in DuckDB."""

_SPACE = r"[\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{_SPACE}'), lambda x: x <> '')"


NGRAM_JOIN = f"""with recursive d as materialized (select doc_id, {_words(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} w from documents),
s as materialized (select distinct doc_id, g from (
  select doc_id, array_to_string(w[i:i + 4], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 3)) i from d where len(w) >= 5)
  union all select doc_id, array_to_string(w, ' ') from d where len(w) between 1 and 4)),
n as materialized (select doc_id, count(*) n from s group by 1),
pair as (select a.doc_id x, b.doc_id y, count(*) i from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
link as materialized (select x, y from pair join n p on x = p.doc_id join n q on y = q.doc_id where 100 * i >= 80 * (p.n + q.n - i)),
reach(a, b) as (select doc_id, doc_id from documents union select a, y from reach join link on b = x)
select d.doc_id, coalesce(n.n, 0) n_shingles, r.component_id from d left join n on d.doc_id = n.doc_id
join (select a, min(b) component_id from reach group by 1) r on d.doc_id = r.a"""

SUBSTRING_DEDUP = f"""with d as materialized (select doc_id, {_words("coalesce(text, '')")} w from documents),
win as materialized (select doc_id, i, array_to_string(w[i:i + 12], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 11)) i from d where len(w) >= 13)),
least as (select g, min(doc_id) m from win group by 1),
gone as materialized (select distinct doc_id, i + k.range p from win join least using (g) cross join range(13) k where m < doc_id),
term as (select doc_id, unnest(w) x, unnest(range(1, len(w) + 1)) p from d),
kept as (select term.doc_id, count(gone.p) n, string_agg(x, ' ' order by term.p) filter (where gone.p is null) t from term left join gone on term.doc_id = gone.doc_id and term.p = gone.p group by 1)
select d.doc_id, len(w) n_words, coalesce(n, 0) n_removed, sha256(coalesce(t, '')) kept_sha256 from d left join kept using (doc_id)"""

LEXICAL_SEARCH = rf"""with d as materialized (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') w from documents),
size as (select count(*)::bigint n_docs, sum(len(w))::bigint n_terms from d where len(w) > 0),
q as materialized (select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) t from benchmark),
tf as materialized (select doc_id, n, t, count(*) tf from (select doc_id, len(w) n, unnest(w) t from d) semi join q using (t) group by 1, 2, 3),
weight as (select t, floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)::double))::bigint wt from (select t, count(*) df from tf group by 1), size),
part as (select doc_id, t, wt * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))) v from tf join weight using (t), size),
score as (select item_id, doc_id, sum(v)::bigint score from q join part using (t) group by 1, 2 having sum(v) > 0)
select item_id, rank::int rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id) rank from score) where rank <= 10"""

_CRC = "list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(conv_id::varchar, ''), lambda x: ord(x)::ubigint)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::ubigint[], lambda x, y: xor(x >> 1, (x & 1) * 3988292384::ubigint)))"
_TURN = "chr(1) || coalesce(role, '') || chr(2) || coalesce(text, '')"

PREFIX_TRIE = f"""with own as materialized (select conv_id, conv_id - conv_id % 20 base, xor({_CRC}, 4294967295::ubigint) % 4 h, list({_TURN} order by turn nulls first, role, text) w from conversations where conv_id is not null group by conv_id),
seq as materialized (select a.conv_id, list_concat(coalesce(b.w[:a.h], []), a.w[a.h + 1:]) s from own a left join own b on b.conv_id = a.base),
member as materialized (select conv_id, len(s) n, d, s[:d] k from (select *, unnest(range(0, len(s) + 1)) d from seq)),
node as materialized (select k, d, min(conv_id) conv_id, count(*) n_convs, coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where n = d), '') ends,
  case when d = 0 then 0 else (count(*) - 1) * len(list_filter(regexp_split_to_array(split_part(k[d], chr(2), 2), '{_SPACE}'), lambda x: x <> '')) end own from member group by k, d),
kids as materialized (select k[:d - 1] k, count(*) n_children from node where d > 0 group by 1),
up as (select k[:e] k, own, leaf from (select node.k, own, (n_children is null)::int leaf, unnest(range(0, d + 1)) e from node left join kids using (k))),
total as (select k, sum(own)::bigint saved_tokens, sum(leaf)::bigint n_leaves from up group by 1)
select node.conv_id, node.d depth, p.conv_id parent_conv_id, node.n_convs, coalesce(n_children, 0) n_children, n_leaves, saved_tokens, sha256(node.ends) ends_sha256
from node join total using (k) left join kids using (k) left join node p on node.d > 0 and p.k = node.k[:node.d - 1]"""


def _url_filter(rules: tuple = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")), order: int = 5, prior: str = "2.0::double", rows: int = 10_000, grams: int = 100_000) -> str:
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block"))
    fits = [f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')" for _, h, p in ranked]
    rule = " ".join(f"when {f} then '{h}{p}'" for f, (_, h, p) in zip(fits, ranked, strict=True))
    verdict = " ".join(f"when {f} then '{v}'" for f, (v, _, _) in zip(fits, ranked, strict=True))
    tail = lambda k: f"g.s[len(g.s) - {k} + 1:]"
    off = lambda side, t: f"ln({prior} / (coalesce({t}.t{side}, 0) + {prior}))"
    ends = [f"left join total t{k} on len(g.s) > {k} and t{k}.s = {tail(k)}" for k in range(1, order)]
    shorter = " ".join(f"+ case when len(g.s) > {k} then {off('y', f't{k}')} - {off('n', f't{k}')} else 0.0::double end" for k in range(1, order))
    p = {}
    for side in "yn":
        q = "1.0::double / 256.0::double"
        for k in range(1, order + 1):
            q = f"case when len(g.s) > {k} then (g{k}.{side} + {prior} * ({q})) / (g{k}.t{side} + {prior}) else {q} end"
        p[side] = f"ln((g.{side} + {prior} * ({q})) / (g.t{side} + {prior}))"
    joins = " ".join(f"left join string_ g{k} on len(g.s) > {k} and g{k}.s = {tail(k)}" for k in range(1, order + 1))
    pad, space = "repeat(chr(2), " + str(order) + ")", "r.w"
    looked = " ".join(f"left join model m{k} on m{k}.s = {space}[{order + 2 - k}:]" for k in range(1, order + 2))
    known = ", ".join(f"m{k}.d" for k in range(order + 1, 0, -1))
    backs = ", ".join(f"m{k}.b" for k in range(order, 0, -1))
    return f"""with addressed as (select page_id, url, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end rest from pages),
split as (select page_id, url, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), '{_UPPER}', '{_LOWER}') host, regexp_extract(substr(coalesce(rest, ''), len(regexp_extract(coalesce(rest, ''), '^[^/?#]*')) + 1), '^[^?#]*') path,
  coalesce(case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else url end, '') t from addressed),
ruled as materialized (select row_number() over () id, *, case {rule} end rule, case {verdict} end ruled from split),
label as (select distinct t, (ruled = 'allow')::int good, md5(t) o from ruled where ruled is not null),
sample as materialized (select t, good, substr(o, 1, 1) not in ('0', '1', '2') fit from (select *, row_number() over (partition by good order by o, t) k from label) where k <= {rows}),
seen as materialized (select good, substr({pad} || t || chr(3), i, {order + 1}) w from (select good, t, unnest(range(1, len(t) + 2)) i from sample where fit)),
counts as materialized (select s, sum(good)::bigint y, sum(1 - good)::bigint n from (select good, w[{order + 2} - k:] s from seen, (select unnest(range(1, {order + 2})) k)) group by s order by sum(1) desc, len(s), s limit {grams}),
total as materialized (select s[:len(s) - 1] s, sum(y)::bigint ty, sum(n)::bigint tn from counts group by 1),
string_ as materialized (select c.s, y, n, ty, tn from counts c join total t on t.s = c.s[:len(c.s) - 1]),
context as materialized (select g.s, floor((case when len(g.s) > 0 then {off("y", "g")} - {off("n", "g")} else 0.0::double end {shorter}) * 1000000)::bigint b, g.ty, g.tn from total g {" ".join(ends)}),
step as (select g.s, floor(({p["y"]} - {p["n"]}) * 1000000)::bigint - c.b d, null::bigint b from string_ g {joins} join context c on c.s = g.s[:len(g.s) - 1]
  union all select s, floor(({off("y", "context")} - {off("n", "context")}) * 1000000)::bigint, null from context where s = '' union all select s, null, b from context),
model as materialized (select s, max(d) d, max(b) b from step group by s),
unknown as materialized (select coalesce(max(d) filter (where s = ''), 0) d, coalesce(max(b) filter (where s = {pad}), 0) b from model),
text as (select id, null good, t from ruled where ruled is null and coalesce(url, '') <> '' union all select -row_number() over (), good, t from sample where not fit),
r as (select id, good, substr({pad} || t || chr(3), i, {order + 1}) w from (select *, unnest(range(1, len(t) + 2)) i from text)),
scored as materialized (select id, good, floor((sum(coalesce({known}, u.d) + coalesce({backs}, 0)) + max(u.b))::double / count(*))::bigint steps from r {looked} cross join unknown u group by id, good),
per as (select steps, sum(good) y, sum(1 - good) n from scored where good is not null group by steps),
least as materialized (select coalesce((select steps from (select steps, (sum(y) over (order by steps desc)) * sum(n) over () + (sum(n) over (order by steps) - n) * sum(y) over () q from per) order by q desc, steps limit 1), 0) v)
select page_id, host, path, rule, coalesce(ruled, case when coalesce(url, '') <> '' and steps >= v then 'allow' else 'block' end) verdict, steps / 1e6::double score, v / 1e6::double threshold
from ruled left join scored using (id) cross join least"""


URL_FILTER = _url_filter()
