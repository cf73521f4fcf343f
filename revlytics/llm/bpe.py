"""BPE encoding and decoding of whole texts with a public vocabulary.

White space never enters a token of this vocabulary, so a text is encoded word by word: the distinct words of some texts are looked up
together, and a word's ids are remembered by the worker (bounded in bytes) from task to task, until another operator's task ends there. Long unsplit text is encoded as a tree:

1. A text of more than `PART_BYTES` is cut into parts, after white space where there is some, else inside a run of letters (of any script),
   digits or other signs. Parts are Spark rows and are encoded in parallel by tasks.
2. Neighbours are joined pairwise, halves of halves first. Where a run was cut, a window around the join is encoded anew and
   grown until it agrees with the left ids on its left side and with the right ids on its right side, so that only the join changes.
3. What has no white space for `LONG` characters within a part is encoded as the same tree of leaves of that length; a task
   has one core, so its leaves are encoded one after another.

Null texts count as empty and have no ids; repeated rows give equal rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from revlytics.llm.common import at, holding, slices, stage, table, utf8

#: Characters without white space from which the tree is used, and of its leaves.
LONG = 512
#: Bytes of words and ids that a worker remembers, without Python's own.
REMEMBERED = 96 << 20
#: Bytes of text whose new words are encoded together.
TOGETHER = 4 << 20
#: Bytes of a text from which it is dealt to several tasks.
PART_BYTES = 1 << 16


#: Bytes with white space as blanks, and with A-Z in lower case too.
_SPACED = np.arange(256, dtype=np.uint8)
_SPACED[9:14] = 32
_FOLDED = _SPACED.copy()
_FOLDED[65:91] += 32


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """A tokenizer file's encoding of whole texts: little-endian 32-bit ids, and their decoding."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.shown = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.bare = [s.removesuffix("</w>") for s in self.shown]
        self.ends = np.array([s.endswith("</w>") for s in self.shown])
        self.added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.known: dict[str, bytes] = {}
        self.held = 0

    # -- words

    def _encode_words(self, words: list[str]) -> None:
        known, plain, other, signed = self.known, [], [], []
        for w in words:
            if w.isalpha():
                # One run of letters: its last id, and no other, ends a word.
                (plain if (w.isascii() or max(w) < "\u0250") and len(w) <= LONG else other).append(w)
            elif (head := w.rstrip(_SIGNS)) and head is not w and head[-1] < "\u0250" and head[-1].isalnum() and head[-1] != "İ" and "<" not in w:
                signed.append((w, head, w[len(head) :]))
            else:
                other.append(w)
        for i in range(0, len(plain), 512):
            part = plain[i : i + 512]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, np.uint32)
            stop = np.flatnonzero(self.ends[ids]) + 1
            if len(stop) != len(part):
                other += part
                continue
            raw, at = ids.tobytes(), 0
            for w, b in zip(part, (stop * 4).tolist()):
                known[w] = raw[at:b]
                at = b
        short = []
        for w in other:
            if len(w) > LONG:
                known[w] = self.stretch(w).tobytes()
            else:
                short.append(w)
        for i in range(0, len(short), 1024):
            part = short[i : i + 1024]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                known[w] = np.array(e.ids, np.uint32).tobytes()
        # Signs after a letter or digit are a run of their own.
        parts = {p for _, head, tail in signed for p in (head, tail) if p not in known}
        if parts:
            self._encode_words(list(parts))
        for w, head, tail in signed:
            known[w] = known[head] + known[tail]
        self.held += sum(map(len, words)) + 240 * len(words)

    def encode_column(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text of a string column without nulls: each distinct word of the column is looked up once."""
        if self.held > REMEMBERED:
            self.forget()
        data, offsets = utf8(texts)
        flat = _FOLDED[data]
        # The names of special tokens are matched as they are written.
        for n in np.flatnonzero(pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)) if b"<|" in data.tobytes() else ():
            flat[offsets[n] : offsets[n + 1]] = _SPACED[data[offsets[n] : offsets[n + 1]]]
        folded = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(flat))
        lists = pc.split_pattern(folded, " ")
        coded = lists.values.dictionary_encode()
        words, known = coded.dictionary.to_pylist(), self.known
        known[""] = b""
        new = [w for w in words if w not in known]
        if new:
            self._encode_words(new)
        held = [known[w] for w in words]
        size = np.array([len(x) >> 2 for x in held] or [0], np.int64)
        ids = np.frombuffer(b"".join(held), np.uint32)
        start = np.cumsum(size) - size
        which = coded.indices.to_numpy(zero_copy_only=False)
        count = size[which] if len(which) else np.zeros(0, np.int64)
        ends = np.cumsum(count)
        place = np.repeat(start[which] - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0) if len(which) else np.zeros(0, np.int64)
        raw = ids[place].tobytes()
        cut = np.concatenate([[0], ends])[lists.offsets.to_numpy() - lists.offsets[0].as_py()] * 4
        cut = cut.tolist()
        return [raw[a:b] for a, b in zip(cut, cut[1:])]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text."""
        return self.encode_column(pa.array(texts, pa.binary()).cast(pa.string()))

    def forget(self) -> None:
        self.known.clear()
        self.held = 0

    def decode(self, ids: bytes) -> str:
        """As decode(ids, skip_special_tokens=False): this vocabulary has no decoder, tokens are joined by spaces."""
        shown = self.shown
        return " ".join([shown[i] for i in np.frombuffer(ids, np.uint32).tolist()])

    # -- long stretches without white space

    def stretch(self, text: str, leaf: int = LONG) -> np.ndarray:
        """Ids of a text without white space, by the tree."""
        out = []
        for part in re.split("(" + "|".join(map(re.escape, self.added)) + ")", text) if self.added else [text]:
            if part in self.added:
                out.append(self.added[part])
                continue
            for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(part)):
                out += self.tree(piece, leaf)
        return np.array(out, np.uint32)

    def model_ids(self, piece: str) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(piece)]

    def tree(self, piece: str, leaf: int = LONG) -> list[int]:
        """One run (in the vocabulary's byte letters): leaves are encoded apart, neighbours joined pairwise."""
        level = [self.model_ids(piece[i : i + leaf]) for i in range(0, len(piece), leaf)]
        while len(level) > 1:
            level = [self.join(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0] if level else []

    def join(self, left: list[int], right: list[int], window: int = 8) -> list[int]:
        """Ids of two parts of one run put together.

        The window covers the last and first ids of the two. Where its first id is the left part's id at
        that place, and one of its later ids is the right part's id at the same place, every two
        neighbours of the spliced ids are neighbours in a proper encoding, and so is the whole.
        """
        while True:
            a, b = max(0, len(left) - window), min(len(right), window)
            text = "".join([self.bare[i] for i in left[a:]] + [self.bare[i] for i in right[:b]])
            ids = self.model_ids(text)
            starts_as_left = a == 0 or (ids[0] == left[a] and not self.ends[ids[0]])
            if starts_as_left:
                if b == len(right):
                    return left[:a] + ids
                place, at = {}, sum(len(self.bare[i]) for i in left[a:])
                for m, i in enumerate(right[:b]):
                    place[at] = m
                    at += len(self.bare[i])
                at = 0
                for n, i in enumerate(ids[:-1]):
                    m = place.get(at)
                    if n and m is not None and right[m] == i and not self.ends[i]:
                        return left[:a] + ids[:n] + right[m:]
                    at += len(self.bare[i])
            window *= 2

    def glue(self, left: bytes, right: bytes) -> bytes:
        """Ids of two parts of a text cut inside a run: only the run's own ids change."""
        x, y = np.frombuffer(left, np.uint32), np.frombuffer(right, np.uint32)
        if not len(x) or not len(y):
            return left + right
        ends = np.flatnonzero(self.ends[x[:-1]])
        a = int(ends[-1]) + 1 if len(ends) else 0
        stops = np.flatnonzero(self.ends[y])
        b = int(stops[0]) + 1 if len(stops) else len(y)
        mid = np.array(self.join(x[a:].tolist(), y[:b].tolist()), np.uint32)
        return np.concatenate([x[:a], mid, y[b:]]).tobytes()


#: Signs that are one run with others of them, and don't begin another kind of run.
_SIGNS = ".,;:!?#$%*)"
# Runs inside which a text may be cut: letters of any script (but the Korean ones that combine), other signs. The two sides belong to one run; a digit is a run of its
# own. No mark, which could combine with what stands before it, is near, nor an apostrophe, which may begin a run.
_LETTER, _SIGN = r"[\p{L}--[\u1100-\u11ff\ua960-\ua97f\ud7b0-\ud7ff]]", r"[^\s\p{L}\p{N}\p{M}\p{C}'’]"
_CUT = regex.compile(rf"(?V1)(?P<run>{_LETTER}{{4}}(?={_LETTER}{{4}})|{_SIGN}{{4}}(?={_SIGN}{{4}}))|[0-9]{{4}}(?=[0-9]{{4}})")
#: Bytes in which a place to cut is looked for.
_LOOK = 1 << 16
_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder of a vocabulary file. It remembers words from task to task, until a task of another operator ends here."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
        holding(_encoders[path].forget)
    return _encoders[path]


def cut_parts(text: bytes, limit: int) -> list[tuple[bytes, bool]]:
    """Parts of about `limit` bytes; the flag: cut inside a run of letters (no white space was near)."""
    out, at, glued = [], 0, False
    while len(text) - at > limit:
        end, next_glued = None, False
        for m in re.finditer(rb"[\x20\x09-\x0D]", text[at + limit // 2 : at + limit]):
            end = at + limit // 2 + m.end()
        if end is None:
            start = at + limit // 2
            while start < len(text) and text[start] & 0xC0 == 0x80:  # within a character
                start += 1
            part = text[start : start + max(_LOOK, 4 * limit)].decode("utf-8", "ignore")
            before = text[max(0, start - 24) : start].decode("utf-8", "ignore")
            for m in _CUT.finditer(part):
                if "<|" not in (before + part[: m.end()])[-24:]:
                    end, next_glued = start + len(part[: m.end()].encode()), m["run"] is not None
                    break
        if end is None:
            m = re.search(rb"[\x20\x09-\x0D]", text[at + limit :])
            if m is None:
                break
            end = at + limit + m.end()
        out.append((text[at:end], glued))
        at, glued = end, next_glued
    return [*out, (text[at:], glued)]


def with_ids(docs: DataFrame, path: str, made, schema: str, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """made(doc_ids, ids of each document, encoder) -> arrays of `schema`, over all documents, in the tasks that encode them."""
    source = docs.select(at(id_col).alias("doc_id"), F.coalesce(at(text_col).cast("string"), F.lit("")).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            _, offsets = utf8(batch.column("text"))
            for i, j in slices(offsets, TOGETHER):
                ids = own.encode_column(batch.column("text")[i:j])
                cols = made(batch.column("doc_id")[i:j], ids, own)
                yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            ids = own.encode([t.encode() for t in batch.column("text").to_pylist()])
            columns = [*batch.drop_columns(["text"]).columns, pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*(n for n in batch.schema.names if n != "text"), "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, row, text in zip(*(c.to_pylist() for c in batch.columns)):
                for seq, (piece, glued) in enumerate(cut_parts(text.encode(), part_bytes)):
                    yield pa.RecordBatch.from_pylist([{"doc_id": doc_id, "row": row, "seq": seq, "glued": glued, "text": piece.decode()}], parts_schema)

    def together(rows: pa.Table) -> pa.Table:
        own, rows = encoder(path), rows.sort_by("seq")
        level = list(zip(rows.column("ids").to_pylist(), rows.column("glued").to_pylist()))
        while len(level) > 1:  # halves of halves
            pairs = [level[i : i + 2] for i in range(0, len(level), 2)]
            level = [((own.glue(p[0][0], p[1][0]) if p[1][1] else p[0][0] + p[1][0]), p[0][1]) if len(p) == 2 else p[0] for p in pairs]
        cols = made(rows.column("doc_id").combine_chunks()[:1], [level[0][0]], own)
        return pa.Table.from_arrays(list(cols.values()), list(cols))

    short = source.where(F.octet_length("text") <= part_bytes).mapInArrow(whole, schema)
    long = source.where(F.octet_length("text") > part_bytes).withColumn("row", F.monotonically_increasing_id()).select("doc_id", "row", "text")
    parts_type = f"doc_id {kind}, row bigint, seq int, glued boolean, text string"
    parts_schema = pa.schema([("doc_id", to_arrow_type(source.schema["doc_id"].dataType)), ("row", pa.int64()), ("seq", pa.int32()), ("glued", pa.bool_()), ("text", pa.string())])
    parts = stage(long.mapInArrow(cut, parts_type), "parts").repartition("row", "seq")
    coded = parts.mapInArrow(part, f"doc_id {kind}, row bigint, seq int, glued boolean, ids binary")
    return short.unionByName(coded.groupBy("row").applyInArrow(together, schema))


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit), a row for each document."""
    kind = docs.schema[id_col].dataType.simpleString()
    return with_ids(docs, path, lambda doc_ids, ids, own: {"doc_id": doc_ids, "ids": pa.array(ids, pa.binary())}, f"doc_id {kind}, ids binary", id_col, text_col, part_bytes)


def op7_bpe_round_trip(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def digest(doc_ids: pa.Array, ids: list[bytes], own: Encoder) -> dict:
        return {
            "doc_id": doc_ids, "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids_sha256": pa.array([sha(x) for x in ids], pa.string()),
            "decoded_sha256": pa.array([sha(own.decode(x).encode()) for x in ids], pa.string()),
        }

    kind = docs.schema["doc_id"].dataType.simpleString()
    return with_ids(docs, vocabulary_path(), digest, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
