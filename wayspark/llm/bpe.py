"""BPE encoding and decoding with tree concatenation of long unsplit text."""

from __future__ import annotations

import array
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space of the vocabulary's own split, as a character class.
_SPACES = "\t-\r \x85\xa0  -     　"
#: The split of the vocabulary's pre-tokenizer; fixed by its file.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+".replace(r"\s", _SPACES)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, extra = {}, 0
    for b in range(256):
        if b in shown:
            letters[b] = chr(b)
        else:
            letters[b] = chr(256 + extra)
            extra += 1
    return [letters[b] for b in range(256)]


class TreeEncoder:
    """Encodes texts exactly as the tokenizers library does with one vocabulary file.

    Long texts are encoded as a tree of halves (_tree); joins counts the joins. Text is
    cut at white space, runs are split as the vocabulary says, and the ids and
    decoded tokens of short runs and pieces are kept in tables of bounded size. A piece
    of more than `leaf` byte letters is encoded as a tree: its leaves in parallel,
    then neighbours joined pairwise. At a join the last tokens of the left and the
    first tokens of the right side are encoded anew together, in a window that grows
    until its first and last token agree with both sides. Neighbouring tokens that
    the encoder would itself produce side by side make a valid encoding, so that the
    joined sequence is the encoding of the whole.
    """

    def __init__(self, path: str, leaf: int = 2048, most: int = 80_000, span: int = 4096) -> None:
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        vocab = spec["model"]["vocab"]
        self.names = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names.update({i: t for t, i in self.special.items()})
        # the pieces' models: inside a piece no end of a word is near
        self.inner = Tokenizer(BPE(vocab=vocab, merges=merges))
        self.ending = Tokenizer(BPE(vocab=vocab, merges=merges, end_of_word_suffix=self.suffix))
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.pieces = regex.compile(_PIECES).findall
        self.ascii_pieces = re.compile(_PIECES.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9")).findall
        self.split = re.compile(f"[^{_SPACES}]+").findall
        self.odd = re.compile("[\x1c-\x1f]").search
        self.letters = byte_letters()
        self.leaf, self.most, self.span, self.joins = leaf, most, span, 0
        self.model = self.ending.model
        self.table: dict[str, tuple[bytes, bytes]] = {}
        self.old: dict[str, tuple[bytes, bytes]] = {}
        self.piece_table: dict[str, tuple[bytes, bytes]] = {}

    # -- long pieces ----------------------------------------------------------

    def _ids(self, letters: str, ends: bool) -> list[int]:
        return (self.ending if ends else self.inner).encode(letters, add_special_tokens=False).ids

    def _text(self, ids: list[int]) -> str:
        """Byte letters of tokens, without an end of a word."""
        return "".join([self.names[i] for i in ids])

    def _join(self, left: list[int], right: list[int], ends: bool) -> list[int]:
        if not left or not right:
            return left + right
        n = 4
        while True:
            a, b = min(n, len(left)), min(n, len(right))
            last = ends and b == len(right)
            window = self._text(left[len(left) - a :] + right[:b])
            if last and self.suffix and window.endswith(self.suffix):
                window = window[: -len(self.suffix)]
            new = self._ids(window, last)
            agrees_left = a == len(left) or new[0] == left[len(left) - a]
            agrees_right = b == len(right) or new[-1] == right[b - 1]
            if agrees_left and agrees_right:
                return left[: len(left) - a] + new + right[b:]
            n *= 2

    def long_piece(self, letters: str) -> list[int]:
        """Ids of one piece of byte letters, by tree concatenation."""
        parts = [letters[i : i + self.leaf] for i in range(0, len(letters), self.leaf)]
        inner = [e.ids for e in self.inner.encode_batch(parts[:-1], add_special_tokens=False)] if len(parts) > 1 else []
        level = [(ids, False) for ids in inner] + [(self._ids(parts[-1], True), True)]
        while len(level) > 1:
            up = []
            for i in range(0, len(level) - 1, 2):
                (x, _), (y, ends) = level[i], level[i + 1]
                up.append((self._join(x, y, ends), ends))
            if len(level) % 2:
                up.append(level[-1])
            level = up
        return level[0][0]

    def _normal(self, run: str) -> str:
        """A run in composed form and lower case, letter by letter."""
        if run.isascii():
            return run.lower()
        run = unicodedata.normalize("NFC", run)
        return run.lower() if "Σ" not in run else "".join(c.lower() for c in run)

    def _split(self, normal: str) -> list[str]:
        if normal.isalpha():
            return [normal]
        return self.ascii_pieces(normal) if normal.isascii() else self.pieces(normal)

    # -- texts ----------------------------------------------------------------

    def _entry(self, ids: list[int]) -> tuple[bytes, bytes]:
        return array.array("I", ids).tobytes(), " ".join(map(self.names.__getitem__, ids)).encode()

    def _piece(self, piece: str) -> tuple[bytes, bytes]:
        letters = piece if piece.isascii() and piece.isprintable() else "".join(map(self.letters.__getitem__, piece.encode()))
        if len(letters) > self.leaf:
            return self._entry(self.long_piece(letters))
        return self._entry([t.id for t in self.model.tokenize(letters)])

    def _run(self, run: str) -> tuple[bytes, bytes]:
        table, got = self.piece_table, []
        for piece in self._split(self._normal(run)):
            e = table.get(piece)
            if e is None:
                e = self._piece(piece)
                if len(piece) <= 64:
                    table[piece] = e
            got.append(e)
        if len(got) == 1:
            return got[0]
        return b"".join([e[0] for e in got]), b" ".join([e[1] for e in got])

    def room(self) -> None:
        """Keep the tables within their bounds: what is not seen again while one
        generation fills is forgotten."""
        if len(self.table) > self.most:
            self.old, self.table = self.table, {}
        if len(self.piece_table) > self.most:
            self.piece_table = {}

    def runs(self, text: str) -> list[str]:
        return self.split(text) if self.odd(text) else text.split()

    def parts(self, text: str) -> list[tuple[bytes, bytes]]:
        """(ids, decoded tokens) of the parts of a text."""
        if "<|" not in text:
            return self._plain(text)
        out = []
        for seg in self.at_special.split(text):
            if seg in self.special:
                out.append(self._entry([self.special[seg]]))
            elif seg:
                out += self._plain(seg)
        return out

    def _plain(self, text: str) -> list[tuple[bytes, bytes]]:
        self.room()
        return self._tree(text)[1]

    def _tree(self, text: str) -> tuple[list[str], list[tuple[bytes, bytes]]]:
        """The runs of a text and their ids and decoded tokens. A text of more than `span`
        characters is cut in halves, wherever that is, and each is encoded by itself; then
        the runs on either side of the cut are encoded anew together, in a window that
        grows until its first and last run agree with both sides."""
        if len(text) <= self.span:
            runs = self.runs(text)
            return runs, self._entries(runs)
        mid = len(text) // 2
        (left, a), (right, b) = self._tree(text[:mid]), self._tree(text[mid:])
        if not left or not right:
            return left + right, a + b
        self.joins += 1
        glue = "" if self.split(text[mid - 1]) and self.split(text[mid]) else " "
        n = 1
        while True:
            x, y = max(0, len(left) - n), min(n, len(right))
            runs = self.runs(" ".join(left[x:]) + glue + " ".join(right[:y]))
            new = self._entries(runs)
            if (not x or new[0] == a[x]) and (y == len(right) or new[-1] == b[y - 1]):
                return left[:x] + runs + right[y:], a[:x] + new + b[y:]
            n *= 2

    def _entries(self, runs: list[str]) -> list[tuple[bytes, bytes]]:
        table = self.table
        got = list(map(table.get, runs))
        if None in got:
            for i, e in enumerate(got):
                if e is None:
                    run = runs[i]
                    e = table.get(run)
                    if e is None:
                        e = self.old.get(run) or self._run(run)
                        if len(run) <= 64:
                            table[run] = e
                    got[i] = e
        return got

    def encode(self, text: str) -> list[int]:
        a = array.array("I")
        a.frombytes(b"".join([p[0] for p in self.parts(text)]))
        return a.tolist()

    def decode(self, ids: list[int]) -> str:
        """The vocabulary has no decoder: its tokens with one space between."""
        return " ".join(self.names[i] for i in ids if i in self.names)

    def digest(self, text: str) -> tuple[int, str, str]:
        parts = self.parts(text)
        ids = b"".join([p[0] for p in parts])
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(b" ".join([p[1] for p in parts if p[1]])).hexdigest()


def _encoder(path: str, leaf: int) -> TreeEncoder:
    """One encoder for each Python worker."""
    kept = globals().setdefault("_KEPT", {})
    if (path, leaf) not in kept:
        kept[path, leaf] = TreeEncoder(path, leaf)
    return kept[path, leaf]


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Default place of the vocabulary; a parameter of every function here."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(
    docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", leaf: int = 2048, with_ids: bool = False
) -> DataFrame:
    """Encode every whole text, then decode it.

    Returns one row per input row: doc_id, n_tokens, ids_sha256 (ids as little-endian
    unsigned 32-bit integers), decoded_sha256 (UTF-8), and with_ids also ids and
    decoded. Null text counts as empty and has no token. Strings of special tokens in
    a text become their ids, as in the library. Other columns are ignored. Rows are
    independent: nothing is shuffled, and memory is bounded by a batch and the table.
    """
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path, leaf)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                got = [enc.digest(t) for t in texts]
                cols = [part.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    ids = [enc.encode(t) for t in texts]
                    cols += [pa.array(ids, pa.list_(pa.int64())), pa.array([enc.decode(i) for i in ids], pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<bigint>, decoded string" if with_ids else "")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
