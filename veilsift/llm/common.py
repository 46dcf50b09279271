"""Shared storage, streaming Arrow helpers and token encoding for the corpus operators."""

from __future__ import annotations

import array
import json
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One space stands for each run of these bytes: space and TAB..CR.
SPACE_RUN = r"[\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Where it is unset and Spark runs in one process, a temporary folder takes its place.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    root = os.path.join(tempfile.gettempdir(), "checkpoints")
    os.makedirs(root, exist_ok=True)
    return f"file://{root}"


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/veilsift/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a table made by ``stored`` that nothing reads any more."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        if "/veilsift/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def own_names(df: DataFrame, *wanted: str) -> list[str]:
    """The names wanted for further columns; underscores go before one that ``df`` has already."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def crc_fold(name: str):
    """crc32 of an id written as decimal text, modulo five: the split into training and held-out rows."""
    return F.crc32(F.col(name).cast("string").cast("binary")) % 5


def nth_smallest(df: DataFrame, column: str, n: int, bins: int = 4096) -> float | None:
    """The exact n-th smallest value (from 1) of a double column without sorting the table.

    Each pass counts rows in equal-width bins of the current range and zooms into the
    one that holds the rank; the driver sees at most ``bins`` rows a pass. None when
    there are fewer than n rows.
    """
    lo, hi, total = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if n < 1 or total < n:
        return None
    rest, spot = n, F.col(column)
    while lo < hi:
        width = (hi - lo) / bins
        if width == 0 or lo + width == lo:  # neighbours among doubles
            kept = df.where((spot >= lo) & (spot <= hi)).groupBy(spot.alias("v")).count().orderBy("v").collect()
            for v, c in kept:
                if rest <= c:
                    return v
                rest -= c
        inside = df.where((spot >= lo) & (spot <= hi))
        slot = F.least(F.lit(bins - 1), F.floor((spot - lo) / width)).cast("int")
        rows = inside.groupBy(slot.alias("b")).agg(F.count(F.lit(1)).alias("c"), F.min(spot).alias("lo"), F.max(spot).alias("hi")).collect()
        for r in sorted(rows, key=lambda r: r["b"]):
            if rest <= r["c"]:
                lo, hi = r["lo"], r["hi"]
                break
            rest -= r["c"]
    return lo


#: The pre-tokenizer pattern that the fast path reproduces (a fixed value of the vocabulary's file).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# Letters and numbers among the characters below U+0180 after lower-casing.
_L, _N = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f", "0-9\xb2\xb3\xb9\xbc-\xbe"
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-\u012f\u0131-\u017f]*")
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\\s{_L}{_N}]+")


def _byte_alphabet() -> dict[int, str]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def slices(batches, rows: int = 512):
    """Arrow batches in slices of few rows, so what Python makes of them stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class Encoder:
    """Token ids of texts by the tokenizers library, as little-endian 32-bit bytes.

    Where the file's normalizer and pre-tokenizer are the ones known here (NFC, white space, lower
    case; WORD_PATTERN; bytes), a text of characters below U+0180 is cut into pieces directly and
    each distinct piece goes through the library's model once. Any other text, or one that holds a
    special token's string, goes through the whole library. Remembered pieces are bounded by two
    generations: a full young one becomes the old one, and pieces in use move back.
    """

    def __init__(self, spec: str, room: int = 100_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        from tokenizers import Tokenizer

        self.tokenizer, self.room = Tokenizer.from_str(spec), room
        self.model, self.bytes = self.tokenizer.model, _byte_alphabet()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        parts = json.loads(spec)
        self.special = [t["content"] for t in parts.get("added_tokens") or ()]
        self.known = self._known(parts)

    @staticmethod
    def _known(parts: dict) -> bool:
        steps = (parts.get("normalizer") or {}).get("normalizers") or []
        cuts = (parts.get("pre_tokenizer") or {}).get("pretokenizers") or []
        split, byte = (cuts + [{}, {}])[:2]
        return (
            [(x["type"], (x.get("pattern") or {}).get("Regex")) for x in steps] == [("NFC", None), ("Replace", r"\s+"), ("Lowercase", None)]
            and [x["type"] for x in cuts] == ["Split", "ByteLevel"]
            and split["pattern"] == {"Regex": WORD_PATTERN}
            and not byte["add_prefix_space"]
            and not byte["use_regex"]
            and parts.get("post_processor") is None
        )

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for text in texts:
            if self.known and _PLAIN.fullmatch(text) and not any(s in text for s in self.special):
                out.append(self._pieces(_PIECES.findall(text.lower())))
            else:
                out.append(array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes())
        return out

    def _pieces(self, pieces: list[str]) -> bytes:
        try:
            return b"".join(map(self.young.__getitem__, pieces))
        except KeyError:
            pass
        if len(self.young) > self.room:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        for w in set(pieces).difference(young):
            found = old.get(w)
            if found is None:
                spelled = w if w.isascii() else w.encode().decode("latin-1").translate(self.bytes)
                found = array.array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()
            young[w] = found
        return b"".join(map(young.__getitem__, pieces))


_encoders: dict[int, Encoder] = {}


def encoder(spec: str) -> Encoder:
    """The worker's encoder, kept between tasks in a reused Python worker."""
    key = hash(spec)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(spec)
    return _encoders[key]


def tokenizer_spec(path: str) -> str:
    """The tokenizer file's content, read once on the driver (1 to 2 MB) and broadcast."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
