"""Column names, term lists and ranking stages that parameterise the library."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ItemSpec:
    """Column names of the parent table (one row per item)."""

    key: str = "id"
    title: str = "title"
    aired: str = "air_date"
    season: str = "season"
    number: str = "number_in_season"
    views: str = "viewers"
    rating: str = "rating"
    image: str = "image"
    link: str = "link"
    series: str | None = None

    def display(self) -> list[str]:
        return [self.title, self.rating, self.image, self.link]


@dataclass(frozen=True)
class LineSpec:
    """Column names of the child table (many text lines per item)."""

    key: str = "item_id"
    name: str = "who"
    place: str = "place"
    place_key: str = "place_id"
    text: str = "txt"
    speaking: str = "speaking"
    words: str = "words"


@dataclass(frozen=True)
class Terms:
    """Term lists the ranking scores lines against.

    ``names`` and ``places`` are the values a preference may take; the other
    lists decide whether a line counts as sung or as on topic.
    """

    names: tuple[str, ...]
    places: tuple[str, ...]
    song_text: tuple[str, ...]
    song_name: tuple[str, ...]
    topic: tuple[str, ...]


@dataclass(frozen=True)
class Stage:
    """One step of a ranking cascade: sort, cut, then filter what is left.

    ``order`` holds SQL expressions, all descending. ``keep`` is a SQL predicate
    applied after the cut; rows it drops are not replaced. ``expand`` adds a key
    column with the given values before ranking, so a preference is crossed with
    the survivors of the stage before it and never with the whole table.
    """

    order: tuple[str, ...]
    limit: int
    keep: str | None = None
    expand: tuple[str, tuple] | None = None


# The term lists and cuts the default ranking works with.
SONG_TEXT_TERMS = ("singing", "sing")
SONG_NAME_TERMS = ("singer",)
CIVIC_TOPIC_TERMS = (
    "president", "politics", "political", "election", "congress", "right-wing",
    "immigration", "environment", "campaign", "clinton", "obama", "cheney",
)
PRIORITIES = ("Characters", "Location")
CUTS = (40, 20, 5)
