"""Quality rules: counts of words, symbols and lines, and repetition told by a suffix array of each text.

A suffix array of a text's UTF-8 bytes, with the longest common prefix (LCP) of neighbours in it, finds every string
that occurs twice: an LCP interval is a run of neighbours that share at least so many bytes, and its string is a
maximal repeat if the bytes before its occurrences differ as well. Repeats of at least ``LEAST`` bytes count. Their
spans are united; each suffix's longest repeat is its deepest interval, and a repeat that isn't maximal lies inside
one that is, so uniting every suffix's longest repeat unites the spans of all maximal ones. A text passes if the
united spans cover at most ``COVERED`` percent of its bytes and its longest repeat has at most ``LONGEST`` bytes
(occurrences may overlap, so a run of one character is a repeat of itself).

How: texts are handled in slices of up to a megabyte, all suffixes of a slice in one sort by the text's number, six
bytes and the end; then ranks are doubled (12, 24, 48 ... bytes) among those that are still equal. LCPs are
computed only where neighbours share the last length below ``LEAST``, in the order of the text, from coarse to fine:
the place where a suffix's match ends never falls from one suffix to the next, so two that are known bound all
between them, and the bytes compared grow with the text, not with its square. A longer text than a slice is a
slice of its own: about 45 bytes of memory for each of its bytes.

Every text is one row of a map over the table; nothing is shuffled.

Base counts are by the words ``[^\\x20\\x09-\\x0D]+``: word_chars (code points in words), n_symbols (``#*$%&|<>``),
n_dup_lines (lines between \\n with a word that equal an earlier line), n_repeat_words (words in 5-word windows that
occur twice or more). Words, windows and lines are compared by their content, not by hashes. ``base_failed``: under 10
words, or over 20 percent repeated words.

Cases: a null text has no words, no bytes and no repeats; so it fails at the base, as an empty one does. Equal rows
are judged alike, and extra columns are kept, but for those that have the name of a result, which is replaced. An empty
table gives an empty table.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lyndon import ranges
from .texts import slices
from .words import SPACE, spans

LEAST, COVERED, LONGEST = 50, 30, 1000
WINDOW, MIN_WORDS, MAX_REPEATED = 5, 10, 20
ROWS = 1 << 13
HEAD = 6
COMPARED = 1 << 17
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bytes", "n_covered", "longest_repeat", "n_repeats")
RESULT = f"struct<{','.join(f'{c}:bigint' for c in COUNTS)},repeats:array<struct<start:int,end:int>>>"


def suffix_order(data: np.ndarray, ends: np.ndarray, mark: int) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes of the texts in ``data`` by text, then content; and the slots whose suffix shares ``mark`` bytes with the one before.

    ``mark`` is HEAD times a power of two. A suffix that ends within these bytes shares fewer.
    """
    n = len(data)
    text = np.repeat(np.arange(len(ends) - 1, dtype=np.uint64), np.diff(ends))
    left = np.minimum(np.repeat(ends[1:], np.diff(ends)) - np.arange(n), HEAD + 1).astype(np.uint64)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = data
    head = np.ndarray((n,), ">u8", padded, strides=(1,)).astype(np.uint64) >> np.uint64(64 - 8 * HEAD)
    beyond = np.uint64(8) * (np.uint64(HEAD) - np.minimum(left, np.uint64(HEAD)))
    key = text << np.uint64(8 * HEAD + 3) | (head >> beyond << beyond) << np.uint64(3) | left
    order = np.argsort(key)
    key = key[order]
    equal = np.flatnonzero(key[1:] == key[:-1]) + 1  # slots that are in the group of the slot before
    rank = np.empty(n, np.int64)
    fresh = np.ones(n, bool)
    fresh[equal] = False
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    del key, head, beyond, left, text, padded, fresh
    size, shared = HEAD, equal
    while len(equal):
        if size == mark:
            shared = equal
        slots = with_before(equal, n)
        at = order[slots]
        both = rank[at].astype(np.uint64) << np.uint64(32) | rank[at + size].astype(np.uint64)
        way = np.argsort(both, kind="stable")
        at, both = at[way], both[way]
        order[slots] = at
        same = np.zeros(len(slots), bool)
        same[1:] = both[1:] == both[:-1]
        rank[at] = np.maximum.accumulate(np.where(same, 0, slots))
        equal = slots[same]
        size *= 2
    return order, shared if size > mark else equal


def with_before(slots: np.ndarray, n: int) -> np.ndarray:
    """The slots, and those before them, out of n."""
    held = np.zeros(n, bool)
    held[slots] = held[slots - 1] = True
    return np.flatnonzero(held)


def matched(data: np.ndarray, a: np.ndarray, b: np.ndarray, known: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many bytes from a and b on are equal: at least ``known``, at most ``most``."""
    out = known.copy()
    live = np.flatnonzero(out < most)
    while len(live):
        width = int(min(max(COMPARED // len(live), 8), 1 << 16, (most[live] - out[live]).max()))
        going = []
        for k in range(0, len(live), max(COMPARED // width, 1)):
            own = live[k : k + max(COMPARED // width, 1)]
            step = np.arange(width)
            inside = step < (most[own] - out[own])[:, None]
            x, y = (np.where(inside, p[own, None] + out[own, None] + step, 0) for p in (a, b))
            differs = (data[x] != data[y]) | ~inside
            stop = np.where(differs.any(1), differs.argmax(1), width)
            out[own] += stop
            going.append(own[(stop == width) & (out[own] < most[own])])
        live = np.concatenate(going)
    return out


def common_prefixes(data: np.ndarray, ends: np.ndarray, order: np.ndarray, slots: np.ndarray, known: int) -> np.ndarray:
    """The LCP at each of ``slots`` with the suffix one slot before, which is at least ``known``."""
    by_place = np.argsort(order[slots])
    at, before = order[slots][by_place], order[slots - 1][by_place]
    end = ends[np.searchsorted(ends, at, "right")]
    n = len(at)
    stop = np.zeros(n, np.int64)  # at + LCP never falls from one place to the next in a text
    stride = 1 << max(n - 1, 0).bit_length()
    while n and stride:
        now = np.arange(stride - 1, n, 2 * stride)
        low, high = np.full(len(now), known), end[now] - np.maximum(at[now], before[now])
        has = now >= stride
        low[has] = np.maximum(low[has], stop[now[has] - stride] - at[now[has]])
        has = now + stride < n
        high[has] = np.minimum(high[has], stop[now[has] + stride] - at[now[has]])
        stop[now] = at[now] + matched(data, at[now], before[now], low, high)
        stride //= 2
    out = np.empty(n, np.int64)
    out[by_place] = stop - at
    return out


def intervals(lcp: np.ndarray, slots: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The LCP intervals: arrays of first slot, last slot and length."""
    lead = np.flatnonzero(np.diff(slots, prepend=-2) > 1)
    n = np.diff(np.append(lead, len(slots)))
    pair = lead[n == 1]
    yield slots[pair] - 1, slots[pair], lcp[pair]
    found: list[tuple[int, int, int]] = []
    for k, m in zip(lead[n > 1].tolist(), n[n > 1].tolist(), strict=True):
        first = int(slots[k]) - 1
        open_: list[tuple[int, int]] = []  # begun and not ended: first slot, length
        for i, v in enumerate([*lcp[k : k + m].tolist(), 0]):
            begin = first + i
            while open_ and open_[-1][1] > v:
                begin, length = open_.pop()
                found.append((begin, first + i, length))
            if v and (not open_ or open_[-1][1] < v):
                open_.append((begin, v))
    if found:
        begin, end, length = np.array(found).T
        yield begin, end, length


def repetition(data: np.ndarray, ends: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Per text covered bytes, longest repeat and number of maximal repeats; text, start and end of the united spans."""
    n = len(ends) - 1
    mark = HEAD
    while 2 * mark < LEAST:
        mark *= 2
    zero = np.zeros(n, np.int64)
    nothing = [zero, zero.copy(), zero.copy()], *(np.zeros(0, np.int64) for _ in range(3))
    if not len(data):
        return nothing
    order, slots = suffix_order(data, ends, mark)
    lcp = common_prefixes(data, ends, order, slots, mark)
    slots, lcp = slots[lcp >= LEAST], lcp[lcp >= LEAST]
    if not len(slots):
        return nothing
    text_of = lambda places: np.searchsorted(ends, places, "right") - 1
    longest, count = np.zeros(n, np.int64), np.zeros(n, np.int64)
    np.maximum.at(longest, text_of(order[slots]), lcp)
    # an interval whose occurrences all have the same byte before them isn't maximal
    inside = with_before(slots, len(data))
    begins = np.isin(order[inside], ends[:-1])
    lead = np.where(begins, -1 - inside, data[order[inside] - 1].astype(np.int64))
    varied = np.cumsum(np.concatenate([[0], lead[1:] != lead[:-1]]))
    for first, last, _ in intervals(lcp, slots):
        a, b = np.searchsorted(inside, first), np.searchsorted(inside, last)
        np.add.at(count, text_of(order[first[varied[a] != varied[b]]]), 1)
    # each suffix's longest repeat, by place; ends never fall within a text
    reach = np.zeros(len(inside), np.int64)
    reach[np.searchsorted(inside, slots)] = lcp
    below = np.searchsorted(inside, slots - 1)
    reach[below] = np.maximum(reach[below], lcp)
    by_place = np.argsort(order[inside])
    start = order[inside][by_place]
    stop = np.maximum.accumulate(start + reach[by_place])
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] > stop[:-1]) | (text_of(start[1:]) != text_of(start[:-1]))
    lead = np.flatnonzero(new)
    start, stop = start[lead], stop[np.append(lead[1:], len(start)) - 1]
    text = text_of(start)
    covered = np.bincount(text, stop - start, minlength=n).astype(np.int64)
    return [covered, longest, count], text, start - ends[text], stop - ends[text]


def numbered(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A number for each span of bytes, equal for equal content."""
    sizes = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int32)
    held = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(sizes.tobytes()), pa.py_buffer(data[ranges(starts, stops)].tobytes())])
    return held.dictionary_encode().indices.to_numpy().astype(np.uint64)


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A number for each pair of numbers, equal for equal pairs."""
    return np.unique(left << np.uint64(32) | right, return_inverse=True)[1].astype(np.uint64)


def base_counts(data: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Per text: words, code points in words, symbols, repeated lines, words in repeated windows."""
    n = len(ends) - 1
    per = lambda marked: np.diff(np.concatenate([[0], np.cumsum(marked, dtype=np.int64)])[ends])
    starts, stops, upto = spans(data, ends)
    word = numbered(data, starts, stops)
    row = np.repeat(np.arange(n), np.diff(upto))
    repeated = np.zeros(len(word), bool)
    if len(word) >= WINDOW:
        two = joined(word[:-1], word[1:])
        window = joined(joined(two[:-3], two[2:-1]), word[4:])
        whole = np.flatnonzero(row[4:] == row[:-4])  # windows within one text
        _, which, times = np.unique(joined(row[whole].astype(np.uint64), window[whole]), return_inverse=True, return_counts=True)
        twice = whole[times[which] > 1]
        for k in range(WINDOW):
            repeated[twice + k] = True
    # lines: those between line feeds and the ends of texts
    feeds = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate([ends[:-1], feeds + 1]))
    owner = np.sort(np.concatenate([np.arange(n), np.searchsorted(ends, feeds, "right") - 1]))
    close = np.sort(np.concatenate([ends[1:], feeds]))
    filled = np.searchsorted(starts, close) > np.searchsorted(starts, begin)
    begin, close, owner = begin[filled], close[filled], owner[filled]
    line = joined(owner.astype(np.uint64), numbered(data, begin, close)) if len(begin) else np.zeros(0, np.uint64)
    first = np.unique(line, return_index=True)[1]
    again = np.ones(len(line), bool)
    again[first] = False
    return [np.diff(upto), per(~SPACE[data] & ((data & 0xC0) != 0x80)), per(SYMBOL[data]), np.bincount(owner[again], minlength=n), np.bincount(row[repeated], minlength=n)]


def judged(column: pa.Array) -> pa.Array:
    """The counts and repeats of every text."""
    counts, texts, starts, stops = [], [], [], []
    for k in range(0, len(column), ROWS):
        part = column.slice(k, ROWS)
        for first, _, data, ends in slices(part):
            found, text, start, stop = repetition(data, ends)
            counts.append([*base_counts(data, ends), np.diff(ends), *found])
            texts.append(text + first + k)
            starts.append(start)
            stops.append(stop)
    if not counts:
        return pa.array([], pa.struct([*((c, pa.int64()) for c in COUNTS), ("repeats", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]))
    arrays = [pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*counts, strict=True)]
    text = np.concatenate(texts)
    runs = pa.StructArray.from_arrays([pa.array(np.concatenate(x).astype(np.int32)) for x in (starts, stops)], names=["start", "end"])
    places = np.searchsorted(text, np.arange(len(column) + 1)).astype(np.int32)
    return pa.StructArray.from_arrays([*arrays, pa.ListArray.from_arrays(pa.array(places), runs)], names=[*COUNTS, "repeats"])


def repetition_of(text: Column) -> Column:
    """A struct of the counts by name and ``repeats``, the united spans of bytes that maximal repeats cover."""

    @F.arrow_udf(RESULT)
    def run(column: pa.Array) -> pa.Array:
        return judged(column)

    return run(text)


def quality_rules(docs: DataFrame, covered: int = COVERED, longest: int = LONGEST) -> DataFrame:
    """``docs`` with the counts, ``repeats``, ``base_failed`` and ``kept``."""
    made = [*COUNTS, "repeats", "base_failed", "kept"]
    names = [c for c in docs.columns if c not in made]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), repetition_of(F.col("text")).alias("told"))
    of = lambda c: F.col("told")[c]
    failed = (of("n_words") < MIN_WORDS) | (F.lit(100) * of("n_repeat_words") > F.lit(MAX_REPEATED) * of("n_words"))
    passes = (F.lit(100) * of("n_covered") <= F.lit(covered) * of("n_bytes")) & (of("longest_repeat") <= longest)
    return rows.select("row.*", "told.*", failed.alias("base_failed"), (~failed & passes).alias("kept"))
