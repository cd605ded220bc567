"""Parameters of the analyses, with their default values."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class KeyphraseParams:
    sizes: tuple[int, ...] = (1, 2, 3)        # phrase lengths; 1 is always built, 2..6 allowed
    position_cutoff: int = 5000
    drop_after_cutoff: bool = False           # drop phrases first seen beyond the cutoff
    graph_cutoff: int = 500                   # co-occurrence window, in tokens
    take_top: int = 50
    measure: str = "pagerank"                 # or "betweenness centrality", "load centrality"
    remove_stopwords: bool = True             # of phrases; single words always lose them
    term_len_decay: bool = True
    include_title: bool = False
    correct_subsum: bool = False
    position_mode: str = "exact"              # or "contains": a token may hold the word

    def __post_init__(self) -> None:
        if any(not 1 <= n <= 6 for n in self.sizes):
            raise ValueError(f"phrase lengths are 1 to 6, not {self.sizes}")
        if self.position_mode not in ("exact", "contains"):
            raise ValueError(f"unknown position mode {self.position_mode!r}")
        check_measure(self.measure)

    @property
    def gram_sizes(self) -> tuple[int, ...]:
        return tuple(sorted({1, *self.sizes}))


@dataclass(frozen=True)
class SummaryParams:
    similarity_threshold: float = 0.3
    min_sentences: int = 4
    max_sentences: int = 18
    penalty: float = 0.001
    length_threshold: int = 6
    order_by_occurrence: bool = True
    measure: str = "pagerank"

    def __post_init__(self) -> None:
        check_measure(self.measure)


@dataclass(frozen=True)
class RankParams:
    """Graph ranking. `rounds` fixes the round count; None stops when ranks settle."""
    damping: float = 0.85
    tolerance: float = 1e-6
    max_rounds: int = 100
    rounds: int | None = None
    max_group_edges: int = 1_000_000          # larger graphs are spread over tasks
    max_group_nodes: int = 1024               # and so are graphs of more nodes
    invert: bool = False                      # path measures: length 1/weight, not the weight


@dataclass(frozen=True)
class NameParams:
    min_ratio: int = 90
    min_partial_ratio: int = 100
    min_length: int = 1                       # shortest name tried by containment


@dataclass(frozen=True)
class ShowParams:
    num_characters: int = 50
    remove_names: tuple[str, ...] = ("", "MAN")
    remove_links: tuple[str, ...] = field(default_factory=tuple)
    similar_top: int = 10


MEASURES = ("pagerank", "betweenness centrality", "load centrality")


def check_measure(measure: str) -> None:
    if measure not in MEASURES:
        raise ValueError(f"unknown measure {measure!r}, expected one of {MEASURES}")
