"""Fixed values that must be the same for results to agree across implementations."""

# Probabilities, calibration and weighting.
EPS = 1e-6
LOGIT_CAP = 6.0
SLOPES = (0.74, 0.78, 0.85, 0.92, 1.00)
HARD_CLUSTERS = (0, 1, 2, 5, 6)

# Canonical frame (left-right, anterior-posterior, superior-inferior), 2 mm voxels.
BOX = (128, 128, 92)
TARGET_SPANS = (122.0, 124.0, 82.0)
FRAME_CENTRE = (64.0, 74.0, 46.0)
SPAN_CLIP = (0.8, 1.25)
SLABS = ((38, 64), (64, 90))
SPACING_MM = 2.0

# Intensity scale and projection.
INTENSITY_CAP = 12.0
TAU_SLOPE = 4.090
TAU_OFFSET = 1.259
TAU_FLOOR = 0.5
SHAPE_WINDOW = 15
EROSION_STEPS = 20
EROSION_STEPS_3D = 12
DEPTH_FRACTION = 0.5
CENTRAL_WINDOW = (64, 74, 16)
MIN_ANCHOR_PIXELS = 20
SIGMOID_SHARPNESS = 12.0

# Lesion synthesis.
BACKGROUND_LEVEL = 1.0
