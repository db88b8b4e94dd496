"""Token-id files: a shared zstandard dictionary, one frame per document, and an offset index.

A file ("blob") is one byte string that holds documents in ascending id order:

    magic "TKB2" | bytes of an id u32 | dictionary hash 8 bytes | documents u32 | index | frames

The index has for each document: id i64, id-is-null u8, first byte of the frame
u64, frame length u32, tokens u32, tokens before it in its partition u64, as
consecutive little-endian arrays.  Frames are zstandard-compressed little-endian
unsigned 16- or 32-bit ids; a document is read by binary search in the index and one
decompression.  Blobs are rows of a Parquet folder, so that Spark's commit
protocol and any store that Spark reads hold them.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, stage, utf8

MAGIC = b"TKB2"
BLOB_BYTES = 4 << 20
#: Pieces that a worker remembers; more make it forget all of them.
CACHE_PIECES = 500_000
CHUNK = 4 << 20
#: Stands between the words of a chunk; words that hold it themselves are odd.
BETWEEN = "\x01"
PLAIN = re.compile("[\x01!-~À-ÖØ-öø-ÿ]*")
#: Words with any other than plain Latin characters.
ODD = re.compile("[^\x01]*[^!-~À-ÖØ-öø-ÿ\x01][^\x01]*")
# What a vocabulary file says of splitting, and the same for the characters of PLAIN in lower case.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLITS = [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|\x01|[^a-zß-öø-ÿ0-9\x01]+")
SPACES = b" \t\n\v\f\r"
DICT_BLOCK = 16 << 10
#: A word that stands between texts and has no ids; no UTF-8 holds this byte.
MARK = b"\xff"
#: Index columns: name and little-endian type.
INDEX = (("doc_id", "<i8"), ("null", "u1"), ("offset", "<u8"), ("length", "<u4"), ("tokens", "<u4"), ("before", "<u8"))


def splits_at_space(path: str) -> bool:
    """Whether the file's vocabulary is of the kind whose pieces :class:`WordEncoder` may encode apart."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or set(t["content"].encode()) & set(SPACES)) for t in spec["added_tokens"])
    model = spec["model"]
    steps = [(spec["normalizer"] or {}).get("normalizers"), (spec["pre_tokenizer"] or {}).get("pretokenizers")]
    return plain and steps == [NORMALIZERS, SPLITS] and model["type"] == "BPE" and model["end_of_word_suffix"] == "</w>" and not model["dropout"]


class WordEncoder:
    """Ids of whole texts by the tokenizers library, each distinct word of a chunk encoded once.

    White space always ends a piece of such a vocabulary, and normalisation and added tokens never
    reach across it, so a text's ids are its words' ids in order.  Words of plain
    Latin characters are cut by the split pattern, and each distinct piece is remembered; words with other
    characters or an added token go to the library whole.  With a vocabulary of any other kind whole texts do.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.lib = Tokenizer.from_file(path)
        vocab = self.lib.get_vocab(with_added_tokens=True)
        top = max(vocab.values(), default=0)
        self.kind = np.dtype("<u2") if top < 0xFF00 else np.dtype("<u4")
        #: No id has a high byte of 255, so that this never occurs in serialized ids, at any offset.
        self.cut = b"\xff" * self.kind.itemsize
        if top >> (8 * self.kind.itemsize - 8) >= 0xFF:
            raise ValueError("ids are too large for the separator")
        self.by_word = splits_at_space(path)
        if not self.by_word:
            return
        added = "|".join(re.escape(t.content) for t in self.lib.get_added_tokens_decoder().values())
        self.added = re.compile(added or "(?!)")
        self.adding = re.compile(f"[^{BETWEEN}]*(?:{added})[^{BETWEEN}]*" if added else "(?!)")
        self.ends = np.zeros(top + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        # the same model for pieces that are normalised and split already
        self.bare = Tokenizer.from_file(path)
        self.bare.encode_special_tokens = True
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.pieces: dict[str, bytes] = {BETWEEN: self.cut}

    def _library(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _learn(self, new: list[str]) -> None:
        """Encode distinct pieces, many to a call; a piece ends at the token that has the end-of-word mark."""
        for lo in range(0, len(new), 256):
            part = new[lo : lo + 256]
            ids = np.array(self.bare.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.kind)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(part) and len(ids) == cuts[-1]:
                at, raw, size = 0, ids.tobytes(), self.kind.itemsize
                for p, c in zip(part, (cuts * size).tolist(), strict=True):
                    self.pieces[p] = raw[at:c]
                    at = c
            else:
                for p in part:
                    self.pieces[p] = self._library(p)

    def _plain(self, text: str) -> bytes:
        """Ids of plain words, with the cut between them."""
        found = SPLIT.findall(text.lower())
        if len(self.pieces) > CACHE_PIECES:
            self.pieces = {BETWEEN: self.cut}
        if new := set(found).difference(self.pieces):  # looks up the few found, not the many kept
            self._learn(list(new))
        return b"".join(map(self.pieces.__getitem__, found))

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, where those of each begin and end)."""
        blob = pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(words)], pa.int64()), words), pa.scalar(BETWEEN.encode(), words.type))[0].as_py()
        text = blob.decode("utf-8", "replace")
        odd = {m[0] for m in ODD.finditer(text)} if not PLAIN.fullmatch(text) else set()
        if self.added.search(text):
            odd.update(m[0] for m in self.adding.finditer(text))
        if odd or blob.count(BETWEEN.encode()) != len(words) - 1:
            every = [w.decode("utf-8", "replace") for w in words.to_pylist()]
            odd.update(w for w in every if BETWEEN in w)
            found = self._plain(BETWEEN.join("" if w in odd else w for w in every)).split(self.cut)
            ids = np.frombuffer(self.cut.join(self._library(w) if w in odd else x for w, x in zip(every, found, strict=True)), self.kind)
        else:
            ids = np.frombuffer(self._plain(text), self.kind)
        cuts = np.flatnonzero(ids == np.frombuffer(self.cut, self.kind)[0])
        return ids, np.concatenate([[-1], cuts, [len(ids)]])

    def _part(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The ids of bytes that begin and end between words, and where texts end among them."""
        text = pa.Array.from_buffers(pa.large_string(), 1, [None, pa.py_buffer(np.array([0, len(data)])), pa.py_buffer(data)])  # bytes may be no valid UTF-8
        found = pc.ascii_split_whitespace(text).values.dictionary_encode()
        words = found.dictionary.view(pa.large_binary())
        mark = pc.equal(words, MARK)
        ids, bounds = self._words(pc.if_else(mark, b"", words))
        place = found.indices.to_numpy()
        size = (np.diff(bounds) - 1)[place]
        ends = np.cumsum(size)
        at = (bounds[:-1] + 1)[place] - (ends - size)
        return ids[np.repeat(at, size) + np.arange(ends[-1] if len(ends) else 0)], ends[mark.to_numpy(zero_copy_only=False)[place]]

    def _long(self, raw: bytes) -> bytes:
        """A text longer than a chunk, in parts that end at white space."""
        out, at = [], 0
        while at < len(raw):
            end = len(raw)
            if end - at > CHUNK:
                gap = max(raw.rfind(c, at, at + CHUNK) for c in (SPACES[i : i + 1] for i in range(len(SPACES))))
                m = re.compile(b"[" + SPACES + b"]").search(raw, at + CHUNK) if gap < 0 else None  # a word longer than a chunk
                end = gap + 1 if gap >= 0 else m.end() if m else end
            out.append(self._part(raw[at:end])[0].tobytes())
            at = end
        return b"".join(out)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Serialized ids of each text, a few megabytes of texts at a time."""
        if not self.by_word:
            return [self._library(t.decode("utf-8", "replace")) for t in texts]
        texts = [t.decode("utf-8", "replace").encode() if MARK in t else t for t in texts]
        out: list[bytes] = []
        offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        for lo, hi in pieces(offs, CHUNK):
            if hi - lo == 1:
                out.append(self._long(texts[lo]))
            else:
                ids, ends = self._part((b" " + MARK + b" ").join(texts[lo:hi]))
                out += [x.tobytes() for x in np.split(ids, ends)]
        return out


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary of serialized id arrays; empty if the samples are too few to train one."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def dict_hash(dictionary: bytes) -> bytes:
    return hashlib.sha256(dictionary).digest()[:8]


@lru_cache(maxsize=2)
def _codecs(dictionary: bytes):
    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=3, dict_data=d), zstandard.ZstdDecompressor(dict_data=d)


def write_blob(rows: list[tuple[int | None, bytes, int]], before: int, dictionary: bytes, width: int) -> bytes:
    """Serialize (id, frame, tokens) rows, in order; ``before``: tokens of the partition before the first; ``width``: bytes of an id."""
    n = len(rows)
    lens = np.array([len(r[1]) for r in rows], np.int64)
    toks = np.array([r[2] for r in rows], np.int64)
    cols = {
        "doc_id": np.array([r[0] or 0 for r in rows]), "null": np.array([r[0] is None for r in rows]), "offset": np.cumsum(lens) - lens,
        "length": lens, "tokens": toks, "before": before + np.cumsum(toks) - toks,
    }
    return b"".join([MAGIC, np.array([width], "<u4").tobytes(), dict_hash(dictionary), np.array([n], "<u4").tobytes(), *(cols[k].astype(t).tobytes() for k, t in INDEX), *(r[1] for r in rows)])


class BlobReader:
    """Short-document access to one blob."""

    def __init__(self, blob: bytes, dictionary: bytes) -> None:
        if blob[:4] != MAGIC or blob[8:16] != dict_hash(dictionary):
            raise ValueError("not a token blob, or written with another dictionary")
        self.blob, self.kind, self.n = blob, np.dtype(f"<u{int(np.frombuffer(blob, '<u4', 1, 4)[0])}"), int(np.frombuffer(blob, "<u4", 1, 16)[0])
        at = 20
        self.index = {}
        for k, t in INDEX:
            self.index[k] = np.frombuffer(blob, t, self.n, at)
            at += self.n * np.dtype(t).itemsize
        self.base, self.codec = at, _codecs(dictionary)[1]

    def ids(self, i: int) -> bytes:
        lo = self.base + int(self.index["offset"][i])
        return self.codec.decompress(self.blob[lo : lo + int(self.index["length"][i])])

    def find(self, doc_id: int) -> bytes | None:
        """The serialized ids of a document, by binary search; None if the blob does not have it."""
        first = int(self.index["null"].sum())
        i = first + int(np.searchsorted(self.index["doc_id"][first:], doc_id))
        return self.ids(i) if i < self.n and self.index["doc_id"][i] == doc_id else None


def write_tokens(df: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", dict_sample: int = 1000, dict_bytes: int = 32 << 10) -> tuple[DataFrame, bytes]:
    """Encode every whole text, append ``end_id``, and write the blobs in ascending id order.

    The dictionary alone is trained on a bounded sample: of about ``dict_sample`` distinct texts, chosen by
    their hashes from all texts, the ids of one block of ``DICT_BLOCK`` bytes that the hash chooses too.
    Returns the stored blobs (part, seq, docs, tokens, blob) and the dictionary.
    A null text is empty (the end id only); null ids come first; repeated ids stand
    side by side, ordered by their frames; an empty table gives no blobs.
    """
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("raw"))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = word_encoder(tokenizer_path)
        seen: set[int] = set()
        for b in batches:
            hashes = b.column(0).to_pylist()
            new = [i for i, h in enumerate(hashes) if h not in seen and not seen.add(h)]
            for i, x in zip(new, enc.encode([b.column(1)[i].as_py() for i in new]), strict=True):
                at = hashes[i] % max(1, -(-len(x) // DICT_BLOCK)) * DICT_BLOCK
                yield pa.RecordBatch.from_arrays([pa.array([hashes[i]], pa.int64()), pa.array([x[at : at + DICT_BLOCK]], pa.binary())], names=["h", "ids"])

    h = F.xxhash64("raw")
    some = texts.where((F.length("raw") > 0) & (F.pmod(h, F.lit(max(1, df.count() // dict_sample))) == 0)).select(h.alias("h"), "raw")
    # copies have one hash; twice the number meant is a bound that chance does not reach
    some = some.mapInArrow(sample, "h long, ids binary").dropDuplicates(["h"]).orderBy("h").limit(2 * dict_sample).collect()
    dictionary = train_dictionary([bytes(r["ids"]) for r in some], dict_bytes)

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = word_encoder(tokenizer_path)
        end = np.array([end_id], enc.kind).tobytes()
        pack = _codecs(dictionary)[0].compress
        for b in batches:
            ids = [x + end for x in enc.encode(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // enc.kind.itemsize for x in ids], pa.int64()), pa.array([pack(x) for x in ids], pa.binary())], names=["doc_id", "n_tokens", "frame"])

    frames = stage(texts.mapInArrow(compress, "doc_id long, n_tokens long, frame binary"), "frames")
    ordered = frames.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "frame").withColumn("part", F.spark_partition_id())

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, seq, before, tokens, part = [], 0, 0, 0, 0, None
        width = word_encoder(tokenizer_path).kind.itemsize

        def blob() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "docs": pa.array([len(rows)], pa.int64()), "tokens": pa.array([tokens], pa.int64()), "blob": pa.array([write_blob(rows, before, dictionary, width)], pa.binary())})

        for b in batches:
            for doc, n, frame, part in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows.append((doc, frame, n))
                held, tokens = held + len(frame), tokens + n
                if held >= BLOB_BYTES:
                    yield blob()
                    seq, before = seq + 1, before + tokens
                    rows, held, tokens = [], 0, 0
        if rows:
            yield blob()

    return stage(ordered.mapInArrow(build, "part int, seq int, docs long, tokens long, blob binary"), "blobs"), dictionary


def read_tokens(blobs: DataFrame, dictionary: bytes) -> DataFrame:
    """Read every document of the blobs: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of unsigned 32-bit ids), ids binary.

    Each partition's first position is a sum over the partitions before it: one
    row for each, fewer than the writer's shuffle partitions.
    """
    totals = sorted((r["part"], r["n"]) for r in blobs.groupBy("part").agg(F.sum("tokens").alias("n")).collect())
    base, at = {}, 0
    for part, n in totals:
        base[part] = at
        at += n

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                r = BlobReader(blob, dictionary)
                crc = [zlib.crc32(np.frombuffer(r.ids(i), r.kind).astype("<u4").tobytes()) for i in range(r.n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r.index["doc_id"].astype(np.int64), pa.int64(), mask=r.index["null"].astype(bool)), pa.array(r.index["before"].astype(np.int64) + base[part]), pa.array(r.index["tokens"].astype(np.int64)), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return blobs.select("part", "blob").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
