"""URL filter: domain rules first, then a weighted vocabulary counted by Aho-Corasick."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

STRICT = ("porn", "porno", "xxx", "hentai", "camgirl", "camgirls", "nsfw", "milf", "bdsm", "xvideos", "sexcam", "fetish")
SOFT = (
    "adult", "sex", "nude", "erotic", "casino", "betting", "gambling", "poker", "slots", "viagra", "pills", "dating",
    "escort", "warez", "torrent", "crack", "keygen", "proxy", "payday", "loans", "lottery", "replica",
)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Rule(NamedTuple):
    action: str  # allow or block
    host: str
    path: str


class Term(NamedTuple):
    text: str
    strict: bool
    weight: float


def default_vocabulary() -> tuple[Term, ...]:
    """A strict term weighs 1, a soft one 0.5: one strict or two distinct soft terms reach 1."""
    return (*(Term(t, True, 1.0) for t in STRICT), *(Term(t, False, 0.5) for t in SOFT))


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.partition("://")[2]
    for mark in "?#":
        rest = rest.partition(mark)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


def longest_rule(host: str, path: str, rules: dict[str, list[Rule]]) -> Rule | None:
    """The longest (host and path) rule whose host is this one or a parent and whose path begins this path."""
    best, at = None, 0
    while host:
        for r in rules.get(host[at:], ()):
            if path.startswith(r.path) and (best is None or len(r.host + r.path) > len(best.host + best.path)):
                best = r
        at = host.find(".", at) + 1
        if not at:
            return best
    return None


@functools.lru_cache(4)
def _automaton(vocabulary: tuple[Term, ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for t in vocabulary:
        found.add_word(t.text.translate(_LOWER), t)
    found.make_automaton()
    return found


def vocabulary_hits(url: str, vocabulary: tuple[Term, ...]) -> list[Term]:
    """Distinct terms that occur with no letter or digit right before or after."""
    text, hits = url.translate(_LOWER), {}
    for last, term in _automaton(vocabulary).iter(text):
        first = last - len(term.text) + 1
        if (first and text[first - 1].isalnum()) or text[last + 1 : last + 2].isalnum():
            continue
        hits[term.text] = term
    return sorted(hits.values())


def filter_urls(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: Sequence[Rule] = (),
    vocabulary: Iterable[Term] | None = None,
    reject_at: float = 1.0,
) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, strict_hits, soft_hits, weight.

    The longest fitting rule decides; without one, ``block`` iff the summed weight of the distinct
    vocabulary terms in the whole url is ``reject_at`` or more. Rules and vocabulary are parameters
    of the program, not data, so they travel with the task. A map without a shuffle: rows may repeat,
    ids may be null, other columns are not read. Null, empty and very long urls are judged alike (null
    has no host and no terms: allow). An empty vocabulary never blocks.
    """
    terms = tuple(default_vocabulary() if vocabulary is None else vocabulary)
    by_host: dict[str, list[Rule]] = {}
    for r in rules:
        by_host.setdefault(r.host, []).append(r)
    id_field = pages.select(id_col).schema[0]

    def judge(batches):
        for batch in batches:
            rows = []
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                rule = longest_rule(host, path, by_host)
                hits = vocabulary_hits(url, terms) if url and terms else []
                weight = sum(t.weight for t in hits)
                verdict = rule.action if rule else "block" if weight >= reject_at else "allow"
                rows.append((host, path, rule and rule.host + rule.path, verdict, [t.text for t in hits if t.strict], [t.text for t in hits if not t.strict], weight))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.string()] * 4 + [pa.list_(pa.string())] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=["id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits", "weight"],
            )

    schema = f"id {id_field.dataType.simpleString()}, host string, path string, rule string, verdict string, strict_hits array<string>, soft_hits array<string>, weight double"
    return pages.select(id_col, url_col).mapInArrow(judge, schema).withColumnRenamed("id", id_col)
