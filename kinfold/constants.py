"""Fixed values that are part of the results."""

#: Similarity from which faces belong together.
COSINE_THRESHOLD = 0.363
#: Room for rounding when averages are compared with the threshold.
LINKAGE_SLACK = 1e-12
#: First name of a cluster that greedy assignment opens is -(known persons + this).
TENTATIVE_BASE = 1_000_000
MAX_HAMMING = 4
MIN_IOU = 0.5
#: Lower-case file name endings of images.
IMAGE_EXTENSIONS = ("bmp", "jpeg", "jpg", "png", "tif", "tiff", "webp")
DETECTOR_MAX_SIDE = 1600
DETECTOR_MIN_SCORE = 0.7
AUTO_NAME = r"^Persona \d+$"
AUTO_NAME_FORMAT = "Persona {}"
UNASSIGNED_COLOR = "#888888"
#: Colours of persons, in the order in which they are given out.
PERSON_PALETTE = (
    "#e6194b", "#3cb44b", "#ffe119", "#4363d8", "#f58231", "#911eb4", "#46f0f0", "#f032e6", "#bcf60c",
    "#fabebe", "#008080", "#e6beff", "#9a6324", "#800000", "#aaffc3", "#808000", "#ffd8b1", "#000075",
)
TAG_DOTS = 4
#: Width of a card, and its height for tall and for wide pictures.
CARD_WIDTH, CARD_HEIGHT_TALL, CARD_HEIGHT_WIDE = 190, 250, 210
DEBOUNCE_SECONDS = 2
THUMBNAIL_SIDE = 480
SCHEMA_VERSION = 1
EMBEDDING_LENGTH = 128
