"""The view: what a reader has chosen, as a value, and its compilation to one logical plan."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chains

VERSION = 2


@dataclass(frozen=True)
class View:
    """Choices compose: pinned reports beat a search's hits, which beat collections; lenses narrow whatever is chosen."""

    books: tuple[str, ...] = ()
    chapters: dict[str, tuple[int, ...]] = field(default_factory=dict)
    pinned: tuple[int, ...] = ()
    query: str = ""
    phrase_only: bool = False
    isolated: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()
    focus: str | None = None

    # Choosing collections or chapters drops pins and search; lenses do not.
    def toggle_book(self, slug: str) -> View:
        return replace(self, books=_toggle(self.books, slug), pinned=(), query="")

    def toggle_chapter(self, slug: str, chapter: int) -> View:
        own = _toggle(self.chapters.get(slug, ()), chapter)
        books = self.books if not own or slug in self.books else (*self.books, slug)
        return replace(self, chapters={**self.chapters, slug: own}, books=books, pinned=(), query="")

    def set_all_books(self, slugs: list[str], on: bool) -> View:
        return replace(self, books=tuple(slugs) if on else (), chapters={}, pinned=(), query="")

    def toggle_kind(self, kind: str) -> View:
        return replace(self, kinds=_toggle(self.kinds, kind))

    def isolate(self, who: str, also: bool = False) -> View:
        return replace(self, isolated=(*[x for x in self.isolated if x != who], who) if also else (who,))

    def release(self, who: str) -> View:
        return replace(self, isolated=tuple(x for x in self.isolated if x != who))

    def pin(self, *ids: int) -> View:
        return replace(self, pinned=tuple(ids))

    def save(self) -> str:
        return json.dumps({"v": VERSION, **asdict(self)})

    @staticmethod
    def load(raw: str | None) -> View | None:
        """A saved view; none if it is of another version or not one at all."""
        try:
            saved = json.loads(raw or "")
            if saved.pop("v") != VERSION or not isinstance(saved["books"], list):
                return None
            chapters = {k: tuple(v) for k, v in dict(saved.pop("chapters")).items()}
            return View(chapters=chapters, **{k: tuple(v) if isinstance(v, list) else v for k, v in saved.items()})
        except (ValueError, TypeError, KeyError, AttributeError):
            return None

    def prune(self, slugs: set[str], reports: set[int], people: set[str]) -> View:
        """Without what no longer exists."""
        return replace(
            self,
            books=tuple(s for s in self.books if s in slugs),
            chapters={s: c for s, c in self.chapters.items() if s in slugs},
            pinned=tuple(i for i in self.pinned if i in reports),
            isolated=tuple(p for p in self.isolated if p in people),
            kinds=tuple(k for k in self.kinds if k in chains.KINDS),
            focus=self.focus if self.focus in people else None,
        )


def _toggle(have: tuple, x) -> tuple:
    return tuple(y for y in have if y != x) if x in have else (*have, x)


def select(view: View, reports: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """The reports in scope before lenses. hits: id of the search's results; none of them falls back to collections."""
    if view.pinned:
        return reports.filter(F.col("id").isin(*view.pinned))
    if hits is not None and not hits.isEmpty():
        return reports.join(hits.select("id").distinct(), "id", "left_semi")
    keep = F.lit(False)
    for slug in view.books:
        own = view.chapters.get(slug, ())
        keep = keep | ((F.col("slug") == slug) & (F.coalesce(F.col("chapter").isin(*own), F.lit(False)) if own else F.lit(True)))
    return reports.filter(keep)


def compile_view(view: View, reports: DataFrame, registry: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """The reports drawn: selection, then paths through the isolated, then kinds, less those without a chain."""
    out = select(view, reports, hits)
    if view.isolated:
        out = out.filter(chains.passes_through(list(view.isolated), F.col("chain"), F.col("slug")))
    if view.kinds:
        out = chains.kinds(out, registry).filter(chains.matches_kinds(list(view.kinds), F.col("kinds"))).drop("kinds")
    return out.filter(F.size("chain") > 0)


def labels(nodes: DataFrame, narrow: bool = False, also: tuple[str, ...] = ()) -> DataFrame:
    """The nodes to name: the heaviest dozen (five if narrow) of a large graph, all of a small one, and those pointed at."""
    top = nodes.orderBy(F.col("weight").desc(), "node").limit(5 if narrow else 12)
    small = nodes.join(nodes.agg(F.count("*").alias("n")).filter("n <= 60"))
    wanted = nodes.filter(F.col("node").isin(*also)) if also else nodes.limit(0)
    return top.unionByName(small.select("node", "weight")).unionByName(wanted).distinct()


def find_reference(reports: DataFrame, query: str) -> DataFrame:
    """slug, id for '12', 'name 12' or 'name:12': the first report of that number in each matching collection."""
    m = re.fullmatch(r"(?:([a-z_0-9-]+)\s*[:\s]\s*)?(\d+)", query.strip().lower())
    if not m:
        return reports.limit(0).select("slug", "id")
    hits = reports.filter(F.col("ref") == int(m[2]))
    if m[1]:
        hits = hits.filter(F.lower("slug").startswith(m[1]) | F.lower("title").contains(m[1]))
    return hits.groupBy("slug").agg(F.min("id").alias("id"))


def find_chapters(chapters: DataFrame, query: str, most: int = 200) -> DataFrame:
    """Chapters whose English title holds the query in any case, or whose Arabic title holds it as typed."""
    q = query.strip()
    hit = F.lower("en").contains(q.lower()) | F.col("ar").contains(q) if q else F.lit(True)
    return chapters.filter(hit).orderBy("id").limit(most)


def page(rows: DataFrame, number: int, first: int = 40, more: int = 160) -> DataFrame:
    """What is shown after `number` requests for more."""
    return rows.limit(first + number * more)


def first_pins(ids, most: int = 60):
    """Of a transmitter's reports, those that 'show only these' pins."""
    return F.slice(ids, 1, most)


def edge_intensity(weight, kind, gap, pairs):
    """How brightly an edge is drawn among so many."""
    density = F.least(F.lit(1.0), F.greatest(F.lit(0.22), 5000 / F.greatest(pairs, F.lit(1))))
    base = F.least(0.05 + F.log1p(weight) * 0.075, F.lit(0.42))
    return F.when((kind == "backward") | gap, F.greatest(base, F.lit(0.26)) * F.greatest(density, F.lit(0.5))).otherwise(base * density)


def node_radius(weight, spacing: float = 1.0):
    return spacing * 0.16 * (1 + F.log1p(weight) * 0.32)
