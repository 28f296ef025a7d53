"""Token ids of white-space words, each distinct word of a slice encoded once.

White space always parts tokens of the vocabulary with word ends, so a text's ids are those of its words in
a row. A plain word (ASCII, and the letters from U+00C0 to U+00FF) is cut into the parts of the vocabulary's
pre-tokenizer by array operations on its bytes: at changes between letters and other signs, around each digit,
and around the English contractions. Each part gets a zero byte behind it, which stands for the word end, and
all parts of a slice go to the fast encoder in one call; it holds the same merges as ranks of byte strings. Any
other word, and any that may hold a special token, goes to the tokenizers library itself. Words of earlier
slices are known by their hashes; of these, the ones that no slice of late has used are given up.
"""

import json

import numpy as np

CACHED_WORDS = 200_000
WORD_END = b"\0"
SIGN, LETTER, DIGIT, ODD = range(4)
KIND = np.full(256, ODD, np.uint8)
KIND[0x21:0x7F] = SIGN
KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
KIND[0x30:0x3A] = DIGIT
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: the letters of the contractions behind an apostrophe: fixed values of the vocabulary's pre-tokenizer
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def byte_of_symbol() -> dict[str, int]:
    """The printable symbol that byte-level vocabularies use for each byte, inverted."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``data`` in a row."""
    upto = np.cumsum(sizes)
    return data[np.repeat(starts - (upto - sizes), sizes) + np.arange(upto[-1] if len(upto) else 0)]


def shifted(x: np.ndarray, by: int, fill: int = 0) -> np.ndarray:
    """x moved ``by`` places to the left."""
    out = np.full(len(x), fill, x.dtype)
    if by < len(x):
        out[: len(x) - by] = x[by:]
    return out


def part_ends(text: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of words in a row (``begins``: true at first bytes): the bytes lower-cased, the last byte of each part, and bytes of words that aren't plain."""
    kind = KIND[text]
    low = LOWER[text]
    # two-byte letters: 0xC3 and 0x80 to 0xBF, of which 0x97 and 0xB7 are signs
    tail = np.zeros(len(text), bool)
    tail[1:] = (text[:-1] == 0xC3) & (text[1:] >= 0x80) & (text[1:] < 0xC0) & ~begins[1:]
    lead = np.zeros(len(text), bool)
    lead[:-1] = tail[1:]
    wide = np.where((text == 0x97) | (text == 0xB7), SIGN, LETTER)
    kind[tail] = wide[tail]
    kind[lead] = wide[1:][tail[1:]]
    capital = tail & (text < 0x9F) & (text != 0x97)
    low[capital] += 0x20

    last = np.ones(len(text), bool)
    follows = ~begins[1:]
    last[:-1] = ~follows | (kind[:-1] != kind[1:]) | (kind[:-1] == DIGIT)
    last[lead] = False
    before = np.ones(len(text), bool)  # what stands before isn't a sign of the same word
    before[1:] = begins[1:] | (kind[:-1] != SIGN)
    mark = (low == 0x27) & before
    inside = ~shifted(begins, 1, True), ~shifted(begins, 2, True)
    for letters in CONTRACTIONS:
        here = mark & inside[0] & (shifted(low, 1) == ord(letters[0]))
        if len(letters) == 2:
            here &= inside[1] & (shifted(low, 2) == ord(letters[1]))
        at = np.flatnonzero(here)
        last[at] = False
        last[at + len(letters)] = True
    odd = kind == ODD
    odd[:-1] |= (text[:-1] == 0x3C) & (text[1:] == 0x7C) & follows
    return low, last, odd


class WordPieces:
    """Encoder of the words of flat byte arrays by the vocabulary file at ``path``."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        end, byte = model["end_of_word_suffix"], byte_of_symbol()

        def raw(symbol: str) -> bytes:
            stem = symbol.removesuffix(end)
            return bytes(byte[c] for c in stem) + WORD_END * (stem != symbol)

        ranks = {bytes([b]): b for b in range(256)} | {bytes([b]) + WORD_END: 255 + b for b in range(1, 256)}
        for pair in model["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            ranks[raw(left) + raw(right)] = len(ranks)
        self.id_of_rank = np.zeros(len(ranks), np.uint32)
        for symbol, i in model["vocab"].items():
            if set(symbol.removesuffix(end)) <= byte.keys() and (rank := ranks.get(raw(symbol))) is not None:
                self.id_of_rank[rank] = i
        self.ends_part = np.zeros(len(ranks), bool)
        self.ends_part[[rank for symbol, rank in ranks.items() if symbol.endswith(WORD_END)]] = True
        self.encoder = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})
        self.keep(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint32))

    def keep(self, keys: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        """The known words: ascending hashes, the number of ids of each, and their ids in a row."""
        self.keys, self.counts, self.ids = keys, counts, ids
        self.starts = np.cumsum(counts) - counts

    def fresh(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words in a row, and the number of ids of each, by the encoders."""
        text = gathered(data, starts, sizes)
        upto = np.cumsum(sizes)
        begins = np.zeros(len(text), bool)
        begins[upto - sizes] = True
        low, last, odd = part_ends(text, begins)
        rare = np.logical_or.reduceat(odd, upto - sizes)
        plain = np.repeat(~rare, sizes)
        low, last = low[plain], last[plain]
        place = np.arange(len(low)) + np.cumsum(last) - last
        marked = np.zeros(len(low) + int(last.sum()), np.uint8)
        marked[place] = low
        ranks = np.asarray(self.encoder.encode_to_numpy(marked.tobytes().decode(), disallowed_special=())) if len(low) else np.zeros(0, np.int64)
        # the place of each part's last id, then of each word's
        part = np.flatnonzero(self.ends_part[ranks]) + 1
        parts = np.cumsum(np.add.reduceat(last.astype(np.int64), np.cumsum(sizes[~rare]) - sizes[~rare])) if len(low) else np.zeros(0, np.int64)
        counts = np.zeros(len(sizes), np.int64)
        counts[~rare] = np.diff(part[parts - 1], prepend=0)
        if not rare.any():
            return self.id_of_rank[ranks], counts
        words = [data[s : s + n].tobytes().decode() for s, n in zip(starts[rare].tolist(), sizes[rare].tolist(), strict=True)]
        other = [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(words, add_special_tokens=False)]
        counts[rare] = [len(x) for x in other]
        ids = np.zeros(counts.sum(), np.uint32)
        of = np.repeat(rare, counts)
        ids[~of], ids[of] = self.id_of_rank[ranks], np.concatenate(other)
        return ids, counts

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and the number of ids of each word."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        keys, at, which = np.unique(hashes, return_index=True, return_inverse=True)
        spot = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        known = self.keys[spot] == keys if len(self.keys) else np.zeros(len(keys), bool)
        counts = np.zeros(len(keys), np.int64)
        counts[known] = self.counts[spot[known]]
        new = at[~known]
        found, counts[~known] = self.fresh(data, starts[new], ends[new] - starts[new]) if len(new) else (np.zeros(0, np.uint32), counts[~known])
        ids = np.zeros(counts.sum(), np.uint32)
        of = np.repeat(known, counts)
        ids[~of] = found
        ids[of] = gathered(self.ids, self.starts[spot[known]], counts[known])
        first = np.cumsum(counts) - counts
        self.remember(keys, counts, ids, which)
        n = counts[which]
        return gathered(ids, first[which], n), n

    def remember(self, keys: np.ndarray, counts: np.ndarray, ids: np.ndarray, which: np.ndarray) -> None:
        """Words that a slice has more than once stay known, and so do earlier ones as long as there is room."""
        often = np.bincount(which, minlength=len(keys)) > 1
        own = ids[np.repeat(often, counts)], keys[often], counts[often]
        old = ~np.isin(self.keys, own[1])
        if int(old.sum()) + len(own[1]) > CACHED_WORDS:
            old[:] = False
        both = np.concatenate([self.keys[old], own[1]])
        order = np.argsort(both)
        numbers = np.concatenate([self.counts[old], own[2]])
        flat = np.concatenate([self.ids[np.repeat(old, self.counts)], own[0]])
        begin = np.cumsum(numbers) - numbers
        self.keep(both[order], numbers[order], gathered(flat, begin[order], numbers[order]))
