"""URL filters: a trie over reversed host labels and path segments.

Rules are pairs of a host and a path prefix. The host's labels, last first, lead from the root to the host's node;
from there the complete segments of the rule's path lead on, and what follows the last slash is kept at the node
as a prefix that the next segment must start with. A URL walks the trie once along its own labels and
segments, collecting the rule with the longest host and, under it, the longest path; no rule is compared
with a URL that does not share its labels. The rule list is a parameter of the caller, at most ``MOST_RULES`` rules,
and reaches executors inside the closure's broadcast.

Results for odd input: a null URL and one without ``://`` have an empty host and path, match no rule and
get the default verdict; the same rule in both lists blocks; an empty table gives an empty result; columns other
than the two named are neither read nor returned; repeated rows are judged each.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_RULES = 1_000_000
_UPPER = {c: c + 32 for c in range(65, 91)}


class UrlTrie:
    """``rules``: (verdict, host, path), the verdict being allow or block."""

    def __init__(self, rules: Iterable[tuple[str, str, str]], default: str = "allow"):
        self.default = default
        self.root: dict = {}
        n = 0
        for verdict, host, path in rules:
            n += 1
            if n > MOST_RULES:
                raise ValueError(f"more than {MOST_RULES} rules")
            host = host.translate(_UPPER)
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(("h", label), {})
            *whole, rest = path.split("/")
            for segment in whole:
                node = node.setdefault(("p", segment), {})
            ends = node.setdefault("ends", {})
            if ends.get(rest, ("", ""))[1] != "block":
                ends[rest] = (host + path, verdict)

    def judge(self, host: str, path: str) -> tuple[str | None, str]:
        """The rule that decides, or None, and the verdict."""
        best = None
        node = self.root
        for label in reversed(host.split(".")) if host else ():
            node = node.get(("h", label))
            if node is None:
                break
            best = self._path(node, path) or best
        return best or (None, self.default)

    @staticmethod
    def _path(node: dict, path: str) -> tuple[str, str] | None:
        best = None
        segments = path.split("/")
        for i, segment in enumerate(segments):
            for rest, rule in sorted(node.get("ends", {}).items(), key=lambda x: len(x[0])):
                if segment.startswith(rest):
                    best = rule
            if i == len(segments) - 1:
                break
            node = node.get(("p", segment))
            if node is None:
                break
        return best


def split_url(url: str | None) -> tuple[str, str]:
    """Host, A-Z lower-cased, and path."""
    scheme, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    rest = rest.partition("#")[0].partition("?")[0]
    host, slash, path = rest.partition("/")
    return host.translate(_UPPER), slash + path


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Per row: page_id, host, path, rule (host and path of the rule that decides, else null), verdict."""
    trie = UrlTrie(rules, default)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            split = [split_url(u) for u in b.column(1).to_pylist()]
            judged = [trie.judge(*s) for s in split]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array([x[i] for x in xs], pa.string()) for xs in (split, judged) for i in (0, 1))],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    return pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url")).mapInArrow(of, "page_id long, host string, path string, rule string, verdict string")
