"""Operator 9: packing by first-fit decreasing with a tournament tree.

Texts become ids in a streaming map; every full sequence's worth of a document is
a sequence by itself. What is left over is dealt at random into groups of a
bounded number of pieces; each group is packed alone, longest piece first, into
the first bin with room, which a tournament tree over the bins' capacities finds
in logarithmic time.

Defined results: null text counts as empty (its one id is the end mark);
repeated rows are documents of their own; ties of length fall to id, start and
CRC; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import functools
import json
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripmart.llm.tables import whole_text
from tripmart.llm.words import chunks, ragged
from tripmart.session import materialize

#: Id after the last of a document.
END = 1

#: Pieces of one group, on average.
GROUP_PIECES = 4096

# Fixed value: the split of texts into pre-tokens that byte-level vocabularies are made for.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def byte_ranks(model: dict) -> dict[bytes, int] | None:
    """Token bytes -> id of a plain byte-level vocabulary whose merges are ranked by id
    (None: it is another kind)."""
    plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    kept = {k: (model.get("pre_tokenizer") or {}).get(k) for k in plain}
    bpe = model["model"]
    if kept != plain or model.get("normalizer") or bpe.get("type") != "BPE" or bpe.get("dropout") or bpe.get("ignore_merges"):
        return None
    if any(t.get(k) for t in model["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        return None
    # printable bytes stand for themselves, the others for the code points from 256 on
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in printable}
    byte |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in byte.values())}
    special = {t["content"] for t in model["added_tokens"]}
    vocab = bpe["vocab"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in bpe["merges"]]
    ids = [vocab["".join(m)] for m in pairs]
    if ids != sorted(ids):
        return None
    return {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in special}


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Ids of a text as the vocabulary file's own library gives them, without added special
    tokens. A plain byte-level vocabulary is read by the faster of the two libraries that
    give the same ids. One reading per process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    ranks = byte_ranks(model)
    if ranks is not None:
        import tiktoken

        special = {t["content"]: t["id"] for t in model["added_tokens"]}
        fast = tiktoken.Encoding("bytes", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens=special)
        return lambda text: fast.encode_to_numpy(text, allowed_special="all")
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    return lambda text: np.array(own.encode(text, add_special_tokens=False).ids, np.uint32)


def pieces(docs: DataFrame, path: str, size: int = 2048, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece of at most ``size`` ids of a document: ``PIECES`` (and
    ``ids`` with ``keep_ids``)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path), np.array([END], np.uint32)
        for batch in batches:
            keys = batch.column(0)
            for lo, hi, texts in chunks(batch.column(1)):
                own = [x for t in texts for x in (encode(t), end)]
                total = np.fromiter(map(len, own), np.int64, len(own)).reshape(-1, 2).sum(axis=1)
                ids = np.concatenate(own).astype("<u4")
                parts = -(-total // size)
                doc = np.repeat(np.arange(hi - lo), parts)
                nth = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
                start = nth * size
                length = np.minimum(size, total[doc] - start)
                begin = np.cumsum(length) - length
                crc = [zlib.crc32(ids[b : b + k].tobytes()) for b, k in zip(begin.tolist(), length.tolist(), strict=True)]
                cols = [keys.take(pa.array(doc + lo)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(total[doc])]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if keep_ids:
                    cols, names = [*cols, ragged(ids.astype(np.int32), length, pa.int32())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return rows.mapInArrow(run, PIECES + (", ids array<int>" if keep_ids else ""))


def first_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, taken in the given order."""
    n = len(lengths)
    wide = 1 << max(0, n - 1).bit_length()
    tree = [size] * (2 * wide)  # tree[k]: most room in any bin below node k
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, need in enumerate(lengths.tolist()):
        k = 1
        while k < wide:
            k *= 2
            if tree[k] < need:
                k += 1
        bins[i], offsets[i] = k - wide, size - tree[k]
        tree[k] -= need
        while k > 1:
            k //= 2
            most = max(tree[2 * k], tree[2 * k + 1])
            if tree[k] == most:
                break
            tree[k] = most
    return bins, offsets


def pack(docs: DataFrame, path: str, size: int = 2048, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False,
         group_pieces: int = GROUP_PIECES, seed: int = 11) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; sequences hold at most ``size`` ids."""
    cut = materialize(pieces(docs, path, size, id_col, text_col, keep_ids), "pieces")
    whole = cut.where(F.col("length") == size).withColumns(
        {"sequence_id": F.monotonically_increasing_id() * 2 + 1, "offset": F.lit(0).cast("long")}
    )
    rest = cut.where(F.col("length") < size)
    groups = max(1, -(-rest.count() // group_pieces))
    rest = rest.withColumn("sequence_id", F.floor(F.rand(seed) * groups).cast("long"))

    def place(group: pa.Table) -> pa.Table:
        order = [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")]
        group = group.sort_by(order)
        bins, offsets = first_fit(group["length"].to_numpy(), size)
        at = group.schema.get_field_index("sequence_id")
        ids = (group["sequence_id"].to_numpy() * (1 << 20) + bins) * 2  # a group never has 2**20 bins
        return group.set_column(at, "sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets))

    packed = rest.groupBy("sequence_id").applyInArrow(place, whole.schema)
    return whole.unionByName(packed).withColumnRenamed("doc_id", id_col)
