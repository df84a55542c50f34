"""Operator 5: byte-pair encoding and decoding with a segment tree over adjacent pair ranks.

A word is a row of symbols. The leaves of its segment tree hold, for each adjacent pair, the pair's merge rank
and its place (rank first), inner nodes the lesser of their children, so the root yields the leftmost pair of
the lowest rank. A merge changes three leaves and the nodes above them. Many words of like length are merged side by
side: tree, symbols and links of all of them are flat numpy arrays, and a step merges one pair of every word that
still has one. Texts are cut into words as the tokenizer file says; words seen before are looked up.

Nulls count as empty texts, which have no ids. Repeated rows each give a row; other columns do not matter.
"""

from __future__ import annotations

import collections
import functools
import gc
import hashlib
import itertools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from wayfold.llm.common import arrow_map, chunks

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"
#: Words that an encoder keeps, and characters of them; beyond it starts anew, so memory stays bounded.
MEMORY, MEMORY_CHARS = 700_000, 24_000_000
#: Symbols that are merged side by side.
SIDE_BY_SIDE = 1 << 17
#: Words of so many bytes are merged one by one, with plain lists: there are too few of them to fill arrays.
LONG_WORD = 1024
NONE = np.iinfo(np.int64).max

#: The word pattern of the byte-level file kind (its pre-tokenizer names it without spelling it out).
BYTE_LEVEL_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Texts of these characters only take the short ways below; all others are cut by the tokenizer library itself.
UNUSUAL = re.compile("[^\t-\r -~\xa0-ɏ]")
TWO_SPACES = re.compile(r"\s\s")


def tokenizer_path(name: str) -> str:
    """A path as it is, or the place of a file of that name in the installed package of public tokenizers."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable Latin-1, else the next from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)]


class Merger:
    """Merges of one vocabulary, applied to many words at once."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = ""):
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.none = max(vocab.values()) + 1
        symbols = byte_symbols()
        self.first = np.array([vocab.get(s, self.none) for s in symbols], dtype=np.int64)
        self.last = np.array([vocab.get(s + suffix, self.none) for s in symbols], dtype=np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], dtype=np.int64)
        # a table of pairs, open to the next free slot; sparse, so nearly all are found where they belong
        self.slots = 1 << (int(len(keys)).bit_length() + 3)
        self.table = np.full(self.slots + 64, -1, dtype=np.int64)
        self.rank = np.zeros(self.slots + 64, dtype=np.int64)
        left, self.tries = np.arange(len(keys)), 0
        while len(left):
            at = self._slot(keys[left]) + self.tries
            free = self.table[at] == -1
            self.table[at[free]] = keys[left[free]]  # of several for a slot the last one stays
            held = self.table[at] == keys[left]
            self.rank[at[held]] = left[held]
            left, self.tries = left[~held], self.tries + 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * 0x9E3779B97F4A7C1 >> 20) & (self.slots - 1)

    def leaves(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """rank << 32 | place for pairs that merge, NONE for others."""
        keys = left << 20 | right
        at = self._slot(keys)
        found = self.table[at]
        out = np.where(found == keys, self.rank[at] << 32 | place, NONE)
        unsure = np.flatnonzero((found != keys) & (found != -1))
        if len(unsure):
            flat, place, keys, at = out.reshape(-1), np.broadcast_to(place, keys.shape).reshape(-1), keys.reshape(-1), at.reshape(-1)
            for k in range(1, self.tries):
                found = self.table[at[unsure] + k]
                hit = unsure[found == keys[unsure]]
                flat[hit] = self.rank[at[hit] + k] << 32 | place[hit]
                unsure = unsure[(found != keys[unsure]) & (found != -1)]
                if not len(unsure):
                    break
        return out

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids of all words in one array, and where in it each word's ids start and how many they are."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        widths = np.where(sizes <= 1, sizes, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
        starts, counts, parts, held = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64), [], 0
        for width in np.unique(widths):
            if width == 0:
                continue
            rows = np.flatnonzero(widths == width)
            if width > LONG_WORD:
                for k in rows.tolist():
                    ids = self._merged_alone(words[k])
                    starts[k], counts[k] = held, len(ids)
                    parts.append(ids)
                    held += len(ids)
                continue
            step = max(1, SIDE_BY_SIDE // int(width))
            for i in range(0, len(rows), step):
                part = rows[i : i + step]
                ids, n = self._merged([words[k] for k in part.tolist()], sizes[part], int(width))
                starts[part], counts[part] = held + np.cumsum(n) - n, n
                parts.append(ids)
                held += len(ids)
        return (np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)), starts, counts

    @functools.cached_property
    def by_pair(self) -> dict[int, int]:
        """The rank of each pair."""
        full = np.flatnonzero(self.table >= 0)
        return dict(zip(self.table[full].tolist(), self.rank[full].tolist(), strict=True))

    def _merged_alone(self, word: bytes) -> np.ndarray:
        """The same tree for one long word."""
        n, ranks, made = len(word), self.by_pair, self.made.tolist()
        sym = self.first[np.frombuffer(word, dtype=np.uint8)].tolist()
        sym[-1] = int(self.last[word[-1]])
        size = 1 << (n - 1).bit_length()
        tree = [NONE] * (2 * size)
        for i in range(n - 1):
            rank = ranks.get(sym[i] << 20 | sym[i + 1])
            if rank is not None:
                tree[size + i] = rank << 32 | i
        for node in range(size - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(place: int, value: int) -> None:
            node = size + place
            tree[node] = value
            while node > 1:
                node >>= 1
                a, b = tree[2 * node], tree[2 * node + 1]
                least = a if a < b else b
                if tree[node] == least:
                    break
                tree[node] = least

        while tree[1] != NONE:
            here, new = tree[1] & 0xFFFFFFFF, made[tree[1] >> 32]
            gone = after[here]
            following, previous = after[gone], before[here]
            sym[here], sym[gone], after[here] = new, -1, following
            put(gone, NONE)
            rank = None
            if following < n:
                before[following] = here
                rank = ranks.get(new << 20 | sym[following])
            put(here, NONE if rank is None else rank << 32 | here)
            if previous >= 0:
                rank = ranks.get(sym[previous] << 20 | new)
                put(previous, NONE if rank is None else rank << 32 | previous)
        return np.array([x for x in sym if x >= 0], dtype=np.int64)

    def _merged(self, words: list[bytes], sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        n, wide = len(words), width + 2  # a place before the first symbol and one after the last
        sym = np.full((n, wide), self.none, dtype=np.int64)
        inside = np.arange(wide)[None, :]
        inside = (inside >= 1) & (inside <= sizes[:, None])
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        sym[inside] = self.first[raw]
        sym[np.arange(n), sizes] = self.last[raw[np.cumsum(sizes) - 1]]
        alive = inside
        if width > 1:
            tree = np.full((n, 2 * width), NONE, dtype=np.int64)
            tree[:, width:] = self.leaves(sym[:, 1 : width + 1], sym[:, 2:], np.arange(width)[None, :])
            half = width
            while half > 1:
                half //= 2
                tree[:, half : 2 * half] = np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2])
            after = np.minimum(np.arange(1, wide + 1)[None, :], sizes[:, None] + 1)
            before = np.tile(np.arange(-1, wide - 1), (n, 1))
            alive = self._steps(sym.reshape(-1), tree.reshape(-1), after.reshape(-1), before.reshape(-1), inside.reshape(-1), n, width).reshape(n, wide)
        return sym[alive], alive.sum(axis=1)

    def _steps(self, sym, tree, after, before, alive, n: int, width: int) -> np.ndarray:
        wide = width + 2
        at, root = np.arange(n) * wide, np.arange(n) * 2 * width
        while True:
            best = tree[root + 1]
            live = best != NONE
            if not live.all():
                at, root, best = at[live], root[live], best[live]
            if not len(at):
                return alive
            here = (best & 0xFFFFFFFF) + 1
            gone = after[at + here]
            following = after[at + gone]
            previous = before[at + here]
            new = self.made[best >> 32]
            sym[at + here] = new
            after[at + here] = following
            before[at + following] = here
            alive[at + gone] = False
            ahead = self.leaves(new, sym[at + following], here - 1)
            behind = np.where(previous > 0, self.leaves(sym[at + previous], new, previous - 1), NONE)
            nodes = np.concatenate([here, gone, np.where(previous > 0, previous, gone)]) - 1 + width
            base = np.concatenate([root, root, root])
            tree[base + nodes] = np.concatenate([ahead, np.full(len(at), NONE), behind])
            while nodes[0] > 1:
                nodes >>= 1
                low = base + 2 * nodes
                tree[base + nodes] = np.minimum(tree[low], tree[low + 1])


def gathered(pool: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """pool[start : start + count] for all, in a row."""
    stops = np.cumsum(counts)
    total = int(stops[-1]) if len(stops) else 0
    return pool[np.repeat(starts - (stops - counts), counts) + np.arange(total)]


def cut_rows(ids: np.ndarray, counts: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    """ids cut after every so many words; counts: ids of each word."""
    ends = np.concatenate([[0], np.cumsum(counts)])[np.cumsum([0, *sizes])].tolist()
    ids = ids.astype(np.uint32)
    return [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


class Known:
    """Stretches of text by number, in the order met, and their ids in one pool."""

    def __init__(self) -> None:
        self.index: collections.defaultdict[str, int] = collections.defaultdict(itertools.count().__next__)
        self.learnt = self.size = self.chars = 0
        self.start, self.count = np.zeros(1 << 12, dtype=np.int64), np.zeros(1 << 12, dtype=np.int64)
        self.pool = np.zeros(1 << 14, dtype=np.int32)

    def indexes(self, stretches) -> np.ndarray:
        return np.fromiter(map(self.index.__getitem__, stretches), dtype=np.int64)

    def new(self) -> list[str]:
        """Those met since the last were learnt."""
        return list(itertools.islice(reversed(self.index), len(self.index) - self.learnt))[::-1]

    def add(self, which: list[int], ids: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> None:
        while len(self.index) > len(self.start):
            self.start, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count))
        while self.size + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.start[which], self.count[which] = starts + self.size, counts
        self.pool[self.size : self.size + len(ids)] = ids
        self.size += len(ids)

    def ids(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = self.count[index]
        return gathered(self.pool, self.start[index], counts), counts


class Encoder:
    """Encodes and decodes texts as the tokenizer file says, by words; made once per Python process."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model.get("end_of_word_suffix") or ""
        self.path, self.by_words, self.has_decoder = path, bool(spec["normalizer"]), bool(spec["decoder"])
        self.merger = Merger(model["vocab"], model["merges"], suffix)
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] if self.by_words else BYTE_LEVEL_WORDS
        self.pattern = regex.compile(pattern)
        self.bytes_of = {s: b for b, s in enumerate(byte_symbols())}
        tokens = {**model["vocab"], **{t["content"]: t["id"] for t in spec["added_tokens"]}}
        self.tokens = [""] * (max(tokens.values()) + 1)
        for token, i in tokens.items():
            self.tokens[i] = token
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.plain, self.spaced = Known(), Known()  # stretches as they are, and those with a space before them
        gc.set_threshold(200_000, 50, 50)  # lists of strings by the thousand, and no cycles among them

    @functools.cached_property
    def library(self):
        """The tokenizer library, to cut up texts of unusual characters."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @functools.cached_property
    def decoded(self) -> list[bytes]:
        """The bytes that each id decodes to."""
        if not self.has_decoder:
            return [t.encode() for t in self.tokens]
        return [t.encode() if t in self.special else bytes(self.bytes_of[c] for c in t) for t in self.tokens]

    def _learn(self, known: Known, lead: str) -> None:
        """Gives ids to the stretches that known has met since: pieces are merged, others put together from their pieces."""
        while new := known.new():
            pure, cut = [], []
            for k, s in enumerate(new, known.learnt):
                pieces = [s] if s.isalpha() or not s else self.pattern.findall(lead + s)
                if len(pieces) == 1:
                    pure.append((k, s))
                else:
                    cut.append((k, pieces))
            known.add([k for k, _ in pure], *self.merger.encode([(lead + s).encode("utf-8") for _, s in pure]))
            known.learnt += len(new)
            known.chars += sum(map(len, new))
            if cut:
                flat = [p for _, pieces in cut for p in pieces]
                ids, counts = self._of_pieces(flat)
                per = np.add.reduceat(counts, np.cumsum([0, *[len(p) for _, p in cut[:-1]]]))
                known.add([k for k, _ in cut], ids, np.cumsum(per) - per, per)

    def _of_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of pieces in a row, and how many each has."""
        with_space = np.array([p[0] == " " and len(p) > 1 for p in pieces], dtype=bool)
        starts, counts = np.zeros(len(pieces), dtype=np.int64), np.zeros(len(pieces), dtype=np.int64)
        pools, base = [], 0
        for known, lead, own in ((self.plain, "", ~with_space), (self.spaced, " ", with_space)):
            at = np.flatnonzero(own)
            index = known.indexes([pieces[k][len(lead) :] for k in at.tolist()])
            pure = known.new()  # each is one piece
            known.add(list(range(known.learnt, known.learnt + len(pure))), *self.merger.encode([(lead + s).encode("utf-8") for s in pure]))
            known.learnt += len(pure)
            ids, n = known.ids(index)
            starts[at], counts[at] = base + np.cumsum(n) - n, n
            pools.append(ids)
            base += len(ids)
        return gathered(np.concatenate(pools), starts, counts), counts

    def _library_pieces(self, text: str) -> list[str]:
        if self.library.normalizer:
            text = self.library.normalizer.normalize_str(text)
        return [bytes(self.bytes_of[c] for c in p).decode("utf-8") for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Special tokens within a text count as such."""
        if len(self.plain.index) + len(self.spaced.index) > MEMORY or self.plain.chars + self.spaced.chars > MEMORY_CHARS:
            self.plain, self.spaced = Known(), Known()
        if not self.split_special or not any("<|" in t for t in texts):
            return self._encode(texts)
        parts = [self.split_special.split(t) if "<|" in t else [t] for t in texts]
        ids = iter(self._encode([p for row in parts for p in row[::2]]))
        return [np.concatenate([next(ids) if i % 2 == 0 else np.array([self.special[p]], dtype=np.uint32) for i, p in enumerate(row)]) for row in parts]

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        usual = [not UNUSUAL.search(t) and (self.by_words or not TWO_SPACES.search(t)) for t in texts]
        quick = iter((self._encode_words if self.by_words else self._encode_bytes)([t for t, u in zip(texts, usual, strict=True) if u]))
        out = []
        for t, u in zip(texts, usual, strict=True):
            if u:
                out.append(next(quick))
            else:
                pieces = self._library_pieces(t) if UNUSUAL.search(t) else self.pattern.findall(t)
                out.append(self._of_pieces(pieces)[0].astype(np.uint32) if pieces else np.zeros(0, dtype=np.uint32))
        return out

    def _encode_words(self, texts: list[str]) -> list[np.ndarray]:
        rows = [t.lower().split() for t in texts]
        index = self.plain.indexes(itertools.chain.from_iterable(rows))
        self._learn(self.plain, "")
        ids, counts = self.plain.ids(index)
        return cut_rows(ids, counts, [len(r) for r in rows])

    def _encode_bytes(self, texts: list[str]) -> list[np.ndarray]:
        """Between single spaces and line ends each stretch stands alone; a line's first has no space before it."""
        lines = [t.split("\n") for t in texts]
        words = [line.split(" ") for row in lines for line in row]
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        heads = self.plain.indexes(itertools.chain(("\n",), (w[0] for w in words)))
        self._learn(self.plain, "")  # before the next line: learning takes all that is new for whole pieces
        tails = self.spaced.indexes(itertools.chain.from_iterable([w[1:] for w in words]))
        self._learn(self.spaced, " ")
        # each line: its head, its tails, and a line end unless it is a text's last
        per_text = np.array([len(row) for row in lines], dtype=np.int64)
        last = np.cumsum(per_text) - 1
        size = sizes + 1
        size[last] -= 1
        first = np.cumsum(size) - size
        starts, counts = np.zeros(size.sum(), dtype=np.int64), np.zeros(size.sum(), dtype=np.int64)
        kind = np.ones(len(starts), dtype=bool)
        kind[first] = False
        ends = np.delete(first + size - 1, last)
        kind[ends] = False
        shift = self.plain.size
        starts[first], counts[first] = self.plain.start[heads[1:]], self.plain.count[heads[1:]]
        starts[ends], counts[ends] = self.plain.start[heads[0]], self.plain.count[heads[0]]
        starts[kind], counts[kind] = self.spaced.start[tails] + shift, self.spaced.count[tails]
        ids = gathered(np.concatenate([self.plain.pool[:shift], self.spaced.pool[: self.spaced.size]]), starts, counts)
        return cut_rows(ids, counts, np.add.reduceat(size, np.cumsum(per_text) - per_text).tolist() if len(texts) else [])

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids as the library gives it with special tokens kept: without a decoder in the file, tokens joined by spaces."""
        tokens = map(self.decoded.__getitem__, ids.tolist())
        if not self.has_decoder:
            return b" ".join(tokens).decode("utf-8")
        return b"".join(tokens).decode("utf-8", errors="replace")


@functools.lru_cache(maxsize=4)
def encoder(name: str) -> Encoder:
    return Encoder(tokenizer_path(name))


def encode(docs: DataFrame, tokenizer: str = WORD_BPE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's key and its ids (array<int>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            for part, texts in chunks(batch, text):
                ids = [x.astype(np.int32) for x in enc.encode(texts)]
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(ids, type=pa.list_(pa.int32()))], [key, "ids"])

    return arrow_map(docs.select(key, text), run, f"{key} {docs.schema[key].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str = WORD_BPE, key: str = "doc_id") -> DataFrame:
    """Each row's key and the text of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            texts = [enc.decode(np.asarray(ids or [], dtype=np.uint32)) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(texts, type=pa.string())], [key, "text"])

    return arrow_map(encoded.select(key, "ids"), run, f"{key} {encoded.schema[key].dataType.simpleString()}, text string")


def round_trip_digests(docs: DataFrame, tokenizer: str = WORD_BPE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes and decodes each text in one pass: key, n_tokens, SHA-256 of the decimal ids and of the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        decimal = [str(i) for i in range(len(enc.tokens))]
        for batch in batches:
            for part, texts in chunks(batch, text):
                counts, id_digests, text_digests = [], [], []
                for raw in enc.encode(texts):
                    ids = raw.tolist()
                    counts.append(len(ids))
                    id_digests.append(hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                    text_digests.append(hashlib.sha256(enc.decode(raw).encode("utf-8")).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(counts, pa.int64()), pa.array(id_digests, pa.string()), pa.array(text_digests, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow_map(docs.select(key, text), run, f"{key} {docs.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
