"""URL filter: a trie over reversed host labels and path segments, with longest-match precedence.

The rules are a small list that a person keeps (``MAX_RULES`` is checked), so the trie that is made from
them is broadcast. Every URL walks down the trie label by label from the top-level domain, then segment by
segment through its path. Of all rules met on the way the deepest host wins, then the longest path; a block
and an allow entry for the very same place resolve to block.

Cases: a null URL, or one without ``://``, has an empty host and path and fits no rule; such a URL, and any
other that no rule fits, gets ``default`` (allow). An empty host never fits. Repeated rows are judged each
on its own. Extra columns are kept; ``host``, ``path``, ``rule`` and ``verdict`` replace columns so named.
An empty table gives an empty table.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RULES = 1_000_000
Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def build_trie(rules: list[Rule]) -> dict:
    """Nodes are dictionaries: a child by label; at "" the path trie of the host that ends there.

    A path trie has a child by whole segment, and at "" the rules whose last, possibly partial, segment
    starts below that node, longest first.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; a broadcast trie takes at most {MAX_RULES}")
    root: dict = {}
    for verdict, host, path in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"unknown verdict {verdict!r}")
        node = root
        for label in reversed(host.lower().split(".")):
            node = node.setdefault(label, {})
        node = node.setdefault("", {})
        *whole, last = path.split("/")
        for segment in whole:
            node = node.setdefault(("/", segment), {})
        ends = node.setdefault("", [])
        ends.append((last, verdict, host + path))
        ends.sort(key=lambda e: (-len(e[0]), e[1] != "block"))
    return root


def longest_match(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """(rule, verdict) of the entry with the deepest host, then the longest path, that fits."""
    below, node = [], trie
    if not host:
        return None
    for label in reversed(host.split(".")):
        node = node.get(label) if label else None
        if node is None:
            break
        if "" in node:
            below.append(node[""])
    segments = path.split("/")
    for node in reversed(below):
        best = None
        for segment in [*segments, None]:
            for last, verdict, rule in node.get("", ()):
                if segment is not None and segment.startswith(last):
                    best = (rule, verdict)
                    break
            node = node.get(("/", segment)) if segment is not None else None
            if node is None:
                break
        if best:
            return best
    return None


def judge_urls(pages: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (null where none fits) and verdict."""
    trie = pages.sparkSession.sparkContext.broadcast(build_trie(rules))

    @F.pandas_udf("rule string, verdict string")
    def judged(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths in parts:
            found = [longest_match(trie.value, h, p) or (None, default) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame(found, columns=["rule", "verdict"], dtype=object)

    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict") or c == url]
    # the row is one struct on the way, so its columns may have any names
    row = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")
    split = pages.select(row, host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    return split.withColumn("judged", judged("host", "path")).select("row.*", "host", "path", "judged.rule", "judged.verdict")
