"""Settings of the engine."""

from __future__ import annotations

from dataclasses import dataclass

from kinfold import constants as C


@dataclass(frozen=True)
class Options:
    """What a library's owner can choose."""

    clustering_threshold: float = C.COSINE_THRESHOLD
    #: "date" for the capture date; all else, "filename" as a rule, for the path.
    sort_order: str = "filename"
    show_face_boxes: bool = True
    #: "3:4" for tall cards; all else, "4:3" as a rule, for wide ones.
    aspect: str = "3:4"
    watch_folder: bool = False
    last_folder: str = ""

    def __post_init__(self):
        if not 0.05 <= self.clustering_threshold <= 0.95:
            raise ValueError("the clustering threshold lies between 0.05 and 0.95")
