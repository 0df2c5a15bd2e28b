"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

The encoder never merges.  An Aho-Corasick automaton over the reversed vocabulary finds, for each
place of a word, the tokens that start there, longest first.  Taken greedily, a token stands if the
pair it forms with its left neighbour is one that merging could leave behind; if none stands,
the last token is taken back and its place is closed.  A sequence whose neighbouring pairs are all
compatible is the result of merging, and each prefix has one such sequence, so a closed place
stays closed and the time is linear in the word.  Pairs are judged once and kept in a table of bounded size.

Words come from the vocabulary file's own normaliser and word pattern, which never reach across white space,
so the different pieces between white space of a batch are encoded once each and their ids gathered by index.  A worker keeps
what it knows of them from batch to batch, in a table of bounded size.

Nulls: a null text is an empty one, and an empty text has no ids and decodes to an empty text.  Texts are used
whole.  Repeated rows and rows without id are encoded like any other.  An empty table gives an empty one.
"""

import json
import re
import string
import unicodedata
from collections.abc import Callable, Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import by_batch, give_back, kept

END = "</w>"
MARK = "\n"  # stands for END inside the automaton; no byte is written this way
#: Bounds on what a worker keeps: units (in each of two generations), the length of one, judged pairs.
KEPT_PIECES, KEPT_LENGTH, KEPT_PAIRS = 150_000, 64, 100_000
#: Texts that are encoded together, as far as they are not too large; a quarter of them where they are decoded, too.
STEP_ROWS = 2000
PUNCTUATION = string.punctuation
#: Latin, Greek and Cyrillic letters lie below; of them these have small forms that depend on their place or are two letters.
FAMILIAR, ODD_CASE, SPACE = "\u0530", re.compile("[\u0130\u03a3]"), re.compile(r"\s")


class PairTable:
    """Which two tokens can stand side by side after all merges."""

    def __init__(self, merges: list[tuple[int, int, int]]) -> None:
        """``merges``: (left, right, made) in their order."""
        self.order = {made: rank for rank, (_, _, made) in enumerate(merges)}
        self.parts = {made: (left, right) for left, right, made in merges}
        self.rank = {(left, right): rank for rank, (left, right, _) in enumerate(merges)}
        self.known: dict[tuple[int, int], bool] = {}

    def compatible(self, left: int, right: int) -> bool:
        pair = (left, right)
        if (known := self.known.get(pair)) is None:
            if len(self.known) >= KEPT_PAIRS:
                self.known.clear()
            known = self.known[pair] = self._judge(left, right)
        return known

    def _judge(self, left: int, right: int) -> bool:
        """Undo merges from the latest to the first; no merge across the border may come before the undone one.

        Of equal merges the left one is made first, hence ``+ 1`` for the right token.
        """
        limit = len(self.rank)
        while True:
            if self.rank.get((left, right), limit) < limit:
                return False
            a, b = self.order.get(left, -1), self.order.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                limit, left = a, self.parts[left][1]
            else:
                limit, right = b + 1, self.parts[right][0]


class WordEncoder:
    """Ids of one word in the byte alphabet of the vocabulary file."""

    def __init__(self, model: dict) -> None:
        ids = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.pairs = PairTable([(ids[a], ids[b], ids[a + b]) for a, b in pairs])
        self.automaton, self.forward = ahocorasick.Automaton(), ahocorasick.Automaton()
        reachable = set(self.pairs.order) | {i for t, i in ids.items() if len(t.removesuffix(END)) == 1}
        for token, i in ids.items():
            if i in reachable:
                shape = token.removesuffix(END) + MARK * token.endswith(END)
                match = i, len(shape)
                self.automaton.add_word(shape[::-1], match)
                self.forward.add_word(shape, match)
        self.automaton.make_automaton()
        self.forward.make_automaton()

    def __call__(self, word: str) -> list[int]:
        """Longest matches from left to right, if they fill the word and all stand; else by backtracking."""
        text = word + MARK
        taken, left, size, compatible = [], -1, 0, self.pairs.compatible
        for _, (token, n) in self.forward.iter_long(text):
            if left >= 0 and not compatible(left, token):
                break
            taken.append(token)
            left, size = token, size + n
        return taken if size == len(text) else self.backtrack(word, text)

    def backtrack(self, word: str, text: str) -> list[int]:
        n = len(text)
        starts: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        for end, match in self.automaton.iter(text[::-1]):
            starts[n - 1 - end].append(match)  # longest first
        compatible = self.pairs.compatible
        closed = bytearray(n + 1)
        taken: list[tuple[int, int, int]] = []  # token, its place, which match of that place
        at = choice = 0
        while at < n:
            last = taken[-1][0] if taken else -1
            for choice in range(choice, len(starts[at])):
                token, size = starts[at][choice]
                if not closed[at + size] and (last < 0 or compatible(last, token)):
                    taken.append((token, at, choice))
                    at, choice = at + size, 0
                    break
            else:
                if not taken:
                    raise ValueError(f"no tokens for {word!r}")
                closed[at] = 1
                _, at, choice = taken.pop()
                choice += 1
        return [token for token, _, _ in taken]


Many = Callable[[list[str]], list[bytes]]


def _gathered(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the parts of each code, one after the other, where code ``c`` has ``sizes[c]`` of them; and where each ends."""
    begins = np.cumsum(sizes) - sizes
    taken = sizes[codes]
    upto = np.append(0, np.cumsum(taken))
    places = np.repeat(begins[codes] - upto[:-1], taken)
    places += np.arange(upto[-1])
    return places, upto


class Pieces(dict):
    """Encoded units, as little-endian 32-bit ids; of bounded size.

    A piece between white space is one unit or a few that the word pattern never joins: letters and the punctuation after them,
    special tokens and what lies between.  Letters that the normaliser only makes small share the small ones' unit.
    """

    def __init__(self, encode: Callable[[str], Iterable[int]], special: dict[str, int], encode_many: Many | None = None, share: int = 1) -> None:
        """``share``: keeps that part of the units it may."""
        super().__init__()
        self.share = share
        self.encode = encode
        self.encode_many = encode_many or (lambda units: [_packed(encode(u)) for u in units])
        self.older: dict[str, bytes] = {}
        self.special = {t: _packed([i]) for t, i in special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def units(self, piece: str) -> list[str]:
        if self.cut is not None and "<" in piece and self.cut.search(piece):
            return [u for p in self.cut.split(piece) if p for u in ([p] if p in self.special else self.units(p))]
        low = piece
        if not (piece.isascii() or (max(piece) < FAMILIAR and not ODD_CASE.search(piece) and unicodedata.is_normalized("NFC", piece))):
            return [piece]
        if not piece.islower():
            low = piece.lower()
            if not (low.isascii() or unicodedata.is_normalized("NFC", low)) or (self.cut and "<" in low and self.cut.search(low)):
                return [piece]  # a special token is one only as it is written
        word = low.rstrip(PUNCTUATION)
        return [word, low[len(word) :]] if word != low and word.isalpha() else [low]

    def known(self, units: list[str]) -> list[bytes]:
        """The ids of different units; what is new is encoded in one call."""
        found = list(map(self.get, units))
        new = []
        for k, held in enumerate(found):
            if held is None:
                unit = units[k]
                held = self.special.get(unit) or self.older.pop(unit, None)
                if held is None:
                    new.append(k)
                else:
                    found[k] = held
                    self._hold(unit, held)
        for k, ids in zip(new, self.encode_many([units[k] for k in new]) if new else []):
            found[k] = ids
            self._hold(units[k], ids)
        return found

    def parted(self, pieces: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The different units of ``pieces``, the numbers of each piece's units one after the other, and how many it has.

        ASCII letters with punctuation after them, which is what most pieces are, are parted as columns.
        """
        ascii_only = pc.string_is_ascii(pieces)
        low = pc.ascii_lower(pieces)
        word = pc.ascii_rtrim(low, PUNCTUATION)
        plain = pc.and_(ascii_only, pc.ascii_is_alpha(word))
        tail = pc.ascii_ltrim(low, string.ascii_lowercase)
        simple = np.asarray(plain)
        closed = simple & (pc.binary_length(tail).to_numpy() > 0)
        others = [self.units(p) for p in pieces.filter(pc.invert(plain)).to_pylist()]
        counts = np.ones(len(pieces), np.int64)
        counts[closed] = 2
        counts[~simple] = [len(u) for u in others]
        begins = np.cumsum(counts) - counts
        columns = [word.filter(plain), tail.filter(pa.array(closed)), pa.array([u for units in others for u in units], pa.string())]
        coded = pa.chunked_array(columns).combine_chunks().dictionary_encode()
        codes = coded.indices.to_numpy()
        n, m = int(simple.sum()), int(closed.sum())
        numbers = np.empty(int(counts.sum()), np.int64)
        rest = np.ones(len(numbers), bool)
        for at, found in ((begins[simple], codes[:n]), (begins[closed] + 1, codes[n : n + m])):
            numbers[at] = found
            rest[at] = False
        numbers[rest] = codes[n + m :]
        return coded.dictionary, numbers, counts

    def _hold(self, unit: str, ids: bytes) -> None:
        """Beyond the bound all units become older ones, and the older ones that nobody asked for go."""
        if len(unit) <= KEPT_LENGTH:
            if len(self) >= KEPT_PIECES // self.share:
                self.older = dict(self)
                self.clear()
            self[unit] = ids

    def batch(self, texts: pa.Array, end_id: int | None = None, id_type: str = "<u4") -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``texts`` one after the other, each closed by ``end_id`` if there is one, and how many each text has."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        flat, rows = split.flatten(), np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy())
        some = pc.greater(pc.binary_length(flat), 0)
        rows = rows[some.to_numpy(zero_copy_only=False)]
        coded = flat.filter(some).dictionary_encode()
        codes = coded.indices.to_numpy()
        units, numbers, counts = self.parted(coded.dictionary)
        del split, flat, coded
        ids = self.known(units.to_pylist())
        pieces = np.bincount(rows, minlength=len(texts))
        if end_id is not None:  # a piece of its own at the end of each text
            codes = np.insert(codes, np.cumsum(pieces), len(counts))
            numbers, counts = np.append(numbers, len(ids)), np.append(counts, 1)
            ids.append(_packed([end_id]))
            pieces = pieces + 1
        # From pieces to units to ids, each by one gather.
        taken, upto = _gathered(codes, counts)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        joined = np.frombuffer(b"".join(ids), "<u4").astype(id_type)
        taken, ends = _gathered(numbers[taken], sizes)
        return joined[taken], np.diff(ends[upto[np.append(0, np.cumsum(pieces))]])

    def text(self, text: str) -> bytes:
        return self.batch(pa.array([text]))[0].tobytes()


def _special(file: dict) -> dict[str, int]:
    odd = [t for t in file["added_tokens"] if t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or not t["content"].split() == [t["content"]]]
    if odd:
        raise ValueError(f"special tokens of this kind are not provided for: {odd}")
    return {t["content"]: t["id"] for t in file["added_tokens"]}


def _packed(ids: Iterable[int]) -> bytes:
    return np.fromiter(ids, "<u4").tobytes()


def _cutters(file: dict) -> tuple:
    """The library's normaliser and word pattern of a vocabulary file, made without its vocabulary."""
    from tokenizers import Tokenizer

    model = file["model"] | {"vocab": {}, "merges": [], "unk_token": None}
    library = Tokenizer.from_str(json.dumps(file | {"model": model, "added_tokens": [], "post_processor": None}))
    return library.normalizer, library.pre_tokenizer


def backtracking_pieces(path: str) -> Pieces:
    """Units encoded by this module; the library's normaliser and word pattern only cut them into words."""

    def make() -> Pieces:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        normalizer, pre_tokenizer = _cutters(file)
        special, word_ids = _special(file), WordEncoder(file.pop("model"))
        give_back()  # a worker keeps neither the library's vocabulary nor the file

        def encode(unit: str) -> list[int]:
            words = pre_tokenizer.pre_tokenize_str(normalizer.normalize_str(unit))
            return [i for word, _ in words for i in word_ids(word)]

        def many(units: list[str], block: int = 8192) -> list[bytes]:
            """Units joined by blanks are cut in one call; a word belongs to the unit in which it starts."""
            out = []
            for at in range(0, len(units), block):
                part = units[at : at + block]
                plain = [u for u in part if not (u.isascii() and u.isalpha()) and not SPACE.search(u)]
                joined = normalizer.normalize_str(" ".join(plain))
                words: dict[str, list[str]] = {}
                if plain and joined.count(" ") == len(plain) - 1:
                    ends = np.cumsum([len(u) + 1 for u in joined.split(" ")])
                    cut = pre_tokenizer.pre_tokenize_str(joined)
                    of = np.searchsorted(ends, [begin for _, (begin, _) in cut], "right").tolist()
                    words = {u: [] for u in plain}
                    for (word, _), k in zip(cut, of):
                        words[plain[k]].append(word)
                for u in part:
                    if u.isascii() and u.isalpha():
                        out.append(_packed(word_ids(u.lower())))
                    elif u in words:
                        out.append(_packed([i for word in words[u] for i in word_ids(word)]))
                    else:
                        out.append(_packed(encode(u)))
            return out

        return Pieces(encode, special, many, share=3)  # new units cost little here

    return kept(("backtracking", path), make)


def library_pieces(path: str) -> Pieces:
    """Units encoded by the tokenizers library."""

    def make() -> Pieces:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()

        def one(unit: str) -> list[int]:
            return library.encode(unit, add_special_tokens=False).ids

        def many(units: list[str], block: int = 8192) -> list[bytes]:
            out = []
            for at in range(0, len(units), block):
                part = units[at : at + block]
                found = library.encode(part, is_pretokenized=True, add_special_tokens=False)
                ids = np.array(found.ids, "<u4").tobytes()
                ends = 4 * np.cumsum(np.bincount(np.array(found.word_ids, np.int64), minlength=len(part)))
                out += [ids[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]
            return out

        return Pieces(one, _special(file), many)

    return kept(("library", path), make)


class OffsetTable:
    """Where each token's bytes lie in one string of all tokens, each followed by a blank."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        if file["decoder"] is not None:
            raise ValueError("tokens are joined by blanks only where the file names no decoder")
        tokens = file["model"]["vocab"] | _special(file)
        names = [b""] * (max(tokens.values()) + 1)
        for token, i in tokens.items():
            names[i] = token.encode() + b" "
        self.bytes = np.frombuffer(b"".join(names), np.uint8)
        self.sizes = np.array([len(n) for n in names])
        self.begins = np.cumsum(self.sizes) - self.sizes

    def __call__(self, ids: np.ndarray, block: int = 1 << 18) -> bytes:
        return self.batch(ids, np.array([len(ids)]), block)[0].as_py()

    def batch(self, ids: np.ndarray, counts: np.ndarray, block: int = 1 << 18) -> pa.Array:
        """The texts of several documents with ``counts`` ids each; the blank after a document's last token goes."""
        upto = np.cumsum(counts)
        last = np.zeros(len(ids), bool)
        last[upto[counts > 0] - 1] = True
        parts, sizes = [], self.sizes[ids] - last
        for at in range(0, len(ids), block):
            part, taken = ids[at : at + block], sizes[at : at + block]
            after = np.cumsum(taken)
            index = np.repeat(self.begins[part] - after + taken, taken)
            index += np.arange(after[-1])
            parts.append(self.bytes[index].tobytes())
        offsets = np.append(0, np.cumsum(sizes))[np.append(0, upto)]
        if offsets[-1] >= 1 << 31:
            raise ValueError("texts of one batch are too large together")
        return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(b"".join(parts))])


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, ids)`` of every row; ids are little-endian unsigned 32-bit integers."""
    return _in_tasks(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), path, True, False)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded`` to ``(doc_id, ids)``."""
    return _in_tasks(encoded.select("doc_id", "ids"), path, False, True)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, ids, decoded)``: ``decode(encode(docs))`` in one pass."""
    return _in_tasks(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), path, True, True)


def _in_tasks(rows: DataFrame, path: str, encodes: bool, decodes: bool) -> DataFrame:
    fields = [("doc_id", pa.int64()), ("ids", pa.binary())] + [("decoded", pa.string())] * decodes

    def make():
        pieces = backtracking_pieces(path) if encodes else None
        table = kept(("offsets", path), lambda: OffsetTable(path)) if decodes else None

        def step(batch: pa.RecordBatch) -> dict:
            if encodes:
                ids, counts = pieces.batch(batch.column("text"))
                offsets = np.append(0, np.cumsum(counts)) * 4
                held = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(ids)])
            else:
                held = pc.fill_null(batch.column("ids"), b"")
                counts = pc.binary_length(held).to_numpy().astype(np.int64) // 4
                ids = np.frombuffer(b"".join(held.to_pylist()), "<u4")
            made = {"doc_id": batch.column("doc_id"), "ids": held}
            if decodes:
                made["decoded"] = table.batch(ids, counts).cast(pa.string())
            return made

        return step

    return rows.mapInArrow(by_batch(make, pa.schema(fields), STEP_ROWS // 4), "doc_id long, ids binary" + ", decoded string" * decodes)


def digests(decoded: DataFrame, *more: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``."""
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *more,
    )
