"""What several operators share: tables in the shared folder, row identity, hashing of bytes and words in numpy."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of most contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A null doc_id sorts after all others.
LAST_ID = 2**63 - 1


_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors share; one of our own only where it is unset and all
    tasks run in this process, as in tests. Elsewhere a missing setting is an error, as a local folder would lose data."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    if not _own_dir:
        _own_dir.append(f"file://{tempfile.mkdtemp(prefix='helixframe-')}")
    return _own_dir[0]


def saved(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """df written as a Parquet table in the shared folder and read again: cuts the lineage and outlives executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string), whatever other columns there are. Batches to Python are kept to 8 MB, so that what a
    worker holds doesn't depend on how long texts are: the session's setting stays so, as plans read it when they run."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def quoted(name: str) -> str:
    """A column's name as Spark reads it, whatever is in it."""
    return "`" + name.replace("`", "``") + "`"


def whole_row(docs: DataFrame) -> Column:
    """All columns in one struct, which operators carry along whatever the columns are called."""
    return F.struct(*[F.col(quoted(c)) for c in docs.columns])


def byte_size(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts: sizes the hash partitions of a corpus."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def crc_mod5(id_col: str = "doc_id"):
    """crc32(doc_id as text) mod 5; a null id counts as remainder 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5, F.lit(0))


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column; null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def give_back() -> None:
    """Returns freed memory to the system: workers are kept between stages, and several share an executor's memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batch: pa.RecordBatch, most: int = 2_000_000, column: str = "text"):
    """Cuts a record batch into runs of rows of about so many bytes of text; one larger row is a run of its own."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    at, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > most:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += size
    if len(sizes) > at:
        yield batch.slice(at)
    give_back()


# Hashing. A row's hash is a polynomial modulo 2^64 with random values for tokens, read off prefix sums; mix() spreads it.
# Such hashes only bring candidates together: results rest on comparisons of bytes or words.

_rng = np.random.default_rng(20240229)
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = {k: int(x) | 5 for k, x in enumerate(_rng.integers(2**40, 2**62, 4, dtype=np.uint64).tolist())}
_powers: dict[tuple[int, bool], np.ndarray] = {}
_SPACES = (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def powers(n: int, base: int = 0, inverse: bool = False) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, or of its inverse."""
    have = _powers.get((base, inverse))
    if have is None or len(have) < n:
        b = _BASES[base]
        size = max(n, 1 << 16)
        have = np.full(size, pow(b, -1, 2**64) if inverse else b, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if size <= 4_000_000:
            _powers[base, inverse] = have
    return have[:n]


def prefix_hash(values: np.ndarray, base: int = 0) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values), base), out=out[1:])
    return out


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = 0) -> np.ndarray:
    """Hash of each span [start, end), alike for equal spans anywhere."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix), base, True)[start])


def gram_hash(prefix: np.ndarray, k: int, base: int = 0) -> np.ndarray:
    """Hash of the k values from each position on."""
    n = len(prefix) - k
    return mix((prefix[k:] - prefix[:n]) * powers(n, base, True)) if n > 0 else np.empty(0, np.uint64)


def word_spans(data: np.ndarray, space: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that are no space."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~space[data]
    turn = np.diff(inside)
    return np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)


def pieces_of(text: bytes, piece: int = 2_000_000) -> Iterator[bytes]:
    """A text in pieces of about so many bytes that end at white space; a longer word is whole."""
    at = 0
    while len(text) - at > piece:
        end = max(text.rfind(c, at, at + piece) for c in _SPACES)
        if end < at:
            end = min((x for c in _SPACES if (x := text.find(c, at + piece)) >= 0), default=len(text) - 1)
        yield text[at : end + 1]
        at = end + 1
    yield text[at:]


class _Digests(dict):
    """Words' hashes: 64 bits of BLAKE2b, which nobody can make two words agree in by construction."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        got = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return got


_digests = _Digests()


def word_hashes(texts: list[bytes], piece: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of the texts, in order, and how many words each text has. Equal words have equal hashes;
    whoever needs the converse compares the words."""
    out, counts = [], []
    for text in texts:
        n = 0
        for part in pieces_of(text, piece):
            words = part.split()
            out.append(np.fromiter(map(_digests.__getitem__, words), np.uint64, len(words)))
            n += len(words)
        counts.append(n)
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), np.array(counts, np.int64)


class Numbers(dict):
    """Numbers things in the order in which they first come: equal numbers, equal things."""

    def __missing__(self, key) -> int:
        got = self[key] = len(self)
        return got


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def map_text(docs: DataFrame, run, fields: str, text_col: str = "text") -> DataFrame:
    """docs with columns appended: run(list of the texts' bytes) returns one Arrow array or list per field. Rows stay whole."""
    added = T._parse_datatype_string(fields)
    schema = T.StructType([*docs.schema.fields, *added.fields])
    own = docs.schema

    def apply(batches):
        out = arrow_schema(schema)
        kinds = [out.field(i).type for i in range(len(own), len(schema))]
        for batch in batches:
            for part in slices(batch, column=text_col):
                made = run(as_bytes(part.column(text_col)))
                made = [x if isinstance(x, pa.Array) else pa.array(x, kind) for x, kind in zip(made, kinds, strict=True)]
                columns = [part.column(i) for i in range(part.num_columns)] + made
                yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return docs.mapInArrow(apply, schema)
