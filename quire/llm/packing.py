"""Sum-of-squares online packing of token sequences into windows of a fixed size."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import python_ready, table, working_for

WINDOW = 1024
#: Id that ends each document.
END_ID = 0
#: Most pieces of text whose ids a Python worker remembers of late, and as many from before (about 200 bytes each).
REMEMBERED = 400_000

_SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Cuts a text only where the tokenizer's own pre-tokenizer cuts it, whatever stands around.
_PIECES = re.compile(f" ?[^{_SPACES}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]")
_CLASS = "[\\t\\n\\x0b\\x0c\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_ODD = f"^$|^{_CLASS}|{_CLASS}$"
_ENDS = ".,;:!?"
#: A word of Latin letters only; in UTF-8 each has one byte or two.
_LETTERS = "^[A-Za-z\\x{c0}-\\x{d6}\\x{d8}-\\x{f6}\\x{f8}-\\x{24f}]+$"
#: Pieces that are encoded in one call.
_AT_ONCE = 200
_codecs: dict[str, Codec] = {}


class Codec:
    """Token ids of whole texts, equal to those of the tokenizer itself.

    A byte-level pre-tokenizer never joins what a single space, or a line end between two words, separates. So texts
    are cut there, the distinct pieces of a batch are encoded once and remembered, and ids are gathered by index. Texts
    with other runs of white space are cut at added tokens, and between them by _PIECES, as the pre-tokenizer would.
    Added tokens hold no white space and take none from beside them.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.line = self._raw("\n")
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        sign = lambda c: level.pre_tokenize_str(c)[0][0]  # noqa: E731 - of each of a character's bytes
        self.space, self.signs = sign(" "), {b: s for c in map(chr, range(0x80, 0x250)) for b, s in zip(c.encode(), sign(c), strict=True)}
        self.ends: dict[str, bytes] = {}
        self.known: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})  # of words after a space, and without
        self.before: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})  # those known before known was full

    def _raw(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _encode_all(self, pieces: list[str]) -> list[bytes]:
        """Pieces without line ends, none with white space at its end, in few calls: set apart by line ends, which the
        tokenizer keeps as tokens of their own."""
        mark, out = int.from_bytes(self.line, "little"), []
        for i in range(0, len(pieces), _AT_ONCE):
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(pieces[i : i + _AT_ONCE])], add_special_tokens=False)[0].ids, dtype="<u4")
            at, raw = 4 * np.flatnonzero(ids == mark), ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *(at + 4).tolist()], [*at.tolist(), len(raw)], strict=True)]
        assert len(out) == len(pieces)
        return out

    def _encode_letters(self, words: list[str], bare: int) -> list[bytes]:
        """Words of Latin letters only (_LETTERS). Each is one piece to the pre-tokenizer, with the space before it, so
        its bytes' signs go to the tokenizer's model at once."""
        model, space, flat, ends = self.tokenizer.model, "" if bare else self.space, [], [0]
        for w in words:
            flat += [t.id for t in model.tokenize(space + (w if w.isascii() else w.encode().decode("latin-1").translate(self.signs)))]
            ends.append(4 * len(flat))
        raw = np.array(flat, dtype="<u4").tobytes()
        return [raw[a:b] for a, b in pairwise(ends)]

    def _pieces(self, text: str) -> list[str]:
        """A text, first parted at added tokens, as the tokenizer does: what stands before one ends as a text does."""
        out, at = [], 0
        for m in self.added.finditer(text) if self.added else ():
            out += [*_PIECES.findall(text[at : m.start()]), m[0]]
            at = m.end()
        return out + _PIECES.findall(text[at:])

    def _ids(self, words: list[str], letters: list[bool], bare: int) -> list[bytes]:
        """Of distinct words that stand after a space, or without one (bare). letters: which are of Latin letters only."""
        known, before = self.known[bare], self.before[bare]
        if len(known) > REMEMBERED:
            before.clear()
            before.update(known)
            known.clear()
        got = list(map(known.get, words))
        missing = [k for k, g in enumerate(got) if g is None]
        for k in missing:
            got[k] = before.get(words[k])
        plain = [k for k in missing if got[k] is None and letters[k]]
        other = [k for k in missing if got[k] is None and not letters[k]]
        for k, x in zip(plain, self._encode_letters([words[k] for k in plain], bare), strict=True):
            got[k] = x
        for k, x in zip(other, self._encode_all([words[k] if bare else " " + words[k] for k in other]), strict=True):
            got[k] = x
        known.update((words[k], got[k]) for k in missing)
        return got

    def _end(self, end: str) -> bytes:
        if end not in self.ends:
            self.ends[end] = self._raw(end) if end else b""
        return self.ends[end]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): text k has ids[bounds[k]:bounds[k + 1]]."""
        texts = texts.fill_null("")
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " \n "), " ")
        flat, offsets = parts.flatten(), np.asarray(parts.offsets) - parts.offsets[0].as_py()
        if not len(flat):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        coded = flat.dictionary_encode()
        codes = np.asarray(coded.indices).astype(np.int64)
        line = np.asarray(pc.equal(coded.dictionary, "\n"))
        odd = np.asarray(pc.match_substring_regex(coded.dictionary, _ODD)) & ~line
        is_line = line[codes]
        first, last = np.zeros(len(codes), dtype=bool), np.zeros(len(codes), dtype=bool)
        some = np.diff(offsets) > 0
        first[offsets[:-1][some]] = True
        last[offsets[1:][some] - 1] = True
        bare = first | is_line
        bare[1:] |= is_line[:-1]
        strange = odd[codes] | (is_line & (first | last))
        strange[1:] |= is_line[1:] & is_line[:-1] & ~first[1:]
        bad = ~some
        bad[some] = np.add.reduceat(strange, offsets[:-1][some]) > 0
        used, where = np.unique(codes * 2 + bare, return_inverse=True)
        # a word of letters with an end after it is two pieces: its stem, which is looked up alone, and that end
        stem = pc.utf8_rtrim(coded.dictionary, characters=_ENDS)
        parted = np.asarray(pc.match_substring_regex(stem, "^\\pL+$")) & np.asarray(pc.not_equal(stem, coded.dictionary))
        ends = {}
        if parted.any():
            mask = pa.array(parted)
            ends = {k: self._end(w[len(x) :]) for k, w, x in zip(np.flatnonzero(parted).tolist(), coded.dictionary.filter(mask).to_pylist(), stem.filter(mask).to_pylist(), strict=True)}
        stem = pc.if_else(pa.array(parted), stem, coded.dictionary).dictionary_encode()
        stems, letters = stem.dictionary.to_pylist(), np.asarray(pc.match_substring_regex(stem.dictionary, _LETTERS))
        of = np.asarray(stem.indices).astype(np.int64)[used >> 1]
        raw: list[bytes] = [b""] * len(used)
        for k in (0, 1):
            own = np.flatnonzero((used & 1 == k) & ~odd[used >> 1] & ~line[used >> 1])
            distinct, at = np.unique(of[own], return_inverse=True)
            ids = self._ids([stems[x] for x in distinct.tolist()], letters[distinct].tolist(), k)
            for i, j, w in zip(own.tolist(), at.tolist(), (used[own] >> 1).tolist(), strict=True):
                raw[i] = ids[j] + ends[w] if w in ends else ids[j]
        for i in np.flatnonzero(line[used >> 1]).tolist():
            raw[i] = self.line
        length = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(np.frombuffer(b"".join(raw), dtype="<u4")))
        out = np.asarray(lists.take(pa.array(where)).flatten())
        bounds = np.concatenate([[0], np.cumsum(length[where])])[offsets]
        if not bad.any():
            return out, bounds
        docs = [out[a:b] for a, b in pairwise(bounds)]
        for k in np.flatnonzero(bad):
            own = self._pieces(texts[int(k)].as_py())
            docs[k] = np.array([i for e in self.tokenizer.encode_batch_fast(own, add_special_tokens=False) for i in e.ids], dtype=np.uint32)
        return np.concatenate(docs), np.concatenate([[0], np.cumsum([len(d) for d in docs])])


def codec(path: str) -> Codec:
    """One for each Python worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def forget() -> None:
    """This Python worker's codecs, with all that they remember."""
    _codecs.clear()


class Packer:
    """Places pieces of up to window tokens, each as it comes, into the open window of the fill level that leaves the
    least sum of squares of the numbers of partly filled windows of each level. Levels are an array of those numbers;
    each has a stack of its windows. close() empties what is left open by cutting pieces."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.level = np.zeros(window + 1, dtype=np.int64)
        self.open: list[list[list]] = [[] for _ in range(window + 1)]

    def put(self, piece: tuple) -> list[tuple] | None:
        """piece: (document, start, length). The full window that it completes, if any."""
        size, window, n = piece[2], self.window, self.level
        if size == window:
            return [piece]
        # placing on level h takes a window from h and adds one at h + size: the sum changes by 2(n[h+size] - n[h] + 1)
        change = 2 * (n[size:window] - n[: window - size] + 1)
        change[0] = 2 * n[size] + 1
        change[1:][n[1 : window - size] == 0] = np.iinfo(np.int64).max
        h = int(np.argmin(change))
        if n[window - size] and 1 - 2 * n[window - size] <= change[h]:
            h = window - size
        held = self.open[h].pop() if h else []
        if h:
            n[h] -= 1
        held.append(piece)
        if h + size == window:
            return held
        n[h + size] += 1
        self.open[h + size].append(held)
        return None

    def close(self) -> Iterator[list[tuple]]:
        """All that is left: the emptiest windows' pieces are cut to fill the others' gaps; the rest of fewer than
        window tokens is cut into sequences whose lengths are powers of two, which need no padding."""
        held = [w for level in self.open for w in level]  # the emptiest first
        pieces = iter([p for w in reversed(held) for p in w])
        self.__init__(self.window)
        row, free = [], self.window
        rest: list[tuple] = []
        for doc, start, size in pieces:
            while size >= free:
                yield [*row, (doc, start, free)]
                start, size, row, free = start + free, size - free, [], self.window
            if size:
                row.append((doc, start, size))
                free -= size
        rest, left = row, self.window - free
        at = iter(rest)
        piece = next(at, None)
        while left:
            want = 1 << (left.bit_length() - 1)
            left -= want
            row = []
            while want:
                doc, start, size = piece
                take = min(size, want)
                row.append((doc, start, take))
                want -= take
                piece = (doc, start + take, size - take) if take < size else next(at, None)
            yield row


_OUT = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _packed(path: str, window: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        working_for("packing", forget)
        sequence = TaskContext.get().partitionId() << 40
        packer, code = Packer(window), codec(path)
        tail: dict[int, tuple] = {}  # what stands open: document's number -> (id, tokens, ids from that place on, place)
        number = 0
        done: list[tuple] = []

        def emit(row: list[tuple]) -> None:
            nonlocal sequence
            offset = 0
            for doc, start, size in row:
                id_, tokens, ids, place = tail[doc]
                done.append((id_, start, size, zlib.crc32(ids[4 * (start - place) : 4 * (start - place + size)]), tokens, sequence, offset))
                offset += size
            sequence += 1

        def flush() -> pa.RecordBatch:
            columns = zip(*done, strict=True) if done else [[]] * len(_OUT)
            out = pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=_OUT)
            done.clear()
            return out

        for batch in batches:
            ids, bounds = code.encode(batch.column(1))
            for id_, (a, b) in zip(batch.column(0).to_pylist(), pairwise(bounds.tolist()), strict=True):
                number += 1
                tokens = b - a + 1
                whole = tokens - tokens % window
                raw = np.append(ids[a:b], np.uint32(END_ID)).astype("<u4").tobytes()
                tail[number] = (id_, tokens, raw, 0)
                for start in range(0, whole, window):
                    emit([(number, start, window)])
                if whole == tokens:
                    del tail[number]
                    continue
                tail[number] = (id_, tokens, raw[4 * whole :], whole)
                if full := packer.put((number, whole, tokens - whole)):
                    emit(full)
                    for doc, _, _ in full:
                        del tail[doc]
            yield flush()
        for row in packer.close():
            emit(row)
        yield flush()

    return go


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """-> a row for each piece: (id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A document's ids are those of the tokenizer (a tokenizers JSON file, which every executor can open) and then
    END_ID. Full windows of a long document stand alone; its rest, or a short document, is placed by Packer. Each
    partition packs its own rows in one pass, without a shuffle: state is the level array and the rests in windows that
    are still open, and at its end open windows are filled up by cutting, so at most one document's rest in a window is
    cut, and nothing is padded (the last tokens of a partition make sequences of powers of two).

    Null or empty text: the one id END_ID. A null id is kept as null. Rows that repeat are packed each. An empty table
    has no rows. Other columns are not read.
    """
    python_ready(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(_packed(tokenizer, window), ", ".join(f"{c} long" for c in _OUT))
    return out.withColumnRenamed("id", id_col)


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())
