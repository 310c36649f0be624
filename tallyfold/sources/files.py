"""Files of a study: snapshots, rate files, manifests, configurations, append-only tables, pages."""

from __future__ import annotations

import hashlib
import json
from html.parser import HTMLParser
from pathlib import Path
from urllib.parse import urlsplit

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import no_nan

_D = T.DoubleType()
SNAPSHOT = T.StructType(
    [T.StructField("symbol", T.StringType(), False), T.StructField("session", T.DateType(), False)]
    + [T.StructField(c, _D) for c in ("open", "high", "low", "close")]
    + [T.StructField("volume", T.LongType())]
    + [T.StructField(c, _D) for c in ("vix", "dxy", "tnx", "oil", "oil_wti", "qqq_close", "iwm_close", "dia_close", "dgs3mo", "dtb3", "dgs2", "dgs10")]
    + [T.StructField("session_minutes", T.IntegerType()), T.StructField("is_half_day", T.IntegerType())]
)
TEXT_SUFFIXES = (".py", ".md", ".yaml", ".yml", ".csv", ".json", ".txt")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing numbers are NULL from the source on."""
    return df.select(*(no_nan(F.col(c)).alias(c) if k in ("double", "float") else F.col(c) for c, k in df.dtypes))


def read_snapshot(spark: SparkSession, folder: str, pattern: str = "market_inputs_*.csv") -> tuple[DataFrame, dict]:
    """The lexicographically last snapshot of the folder and its manifest ({} if it has none); none at all raises."""
    found = sorted(Path(folder).glob(pattern))
    if not found:
        raise FileNotFoundError(f"no {pattern} in {folder}")
    manifest = found[-1].with_name(found[-1].stem + ".manifest.json")
    df = spark.read.schema(SNAPSHOT).csv(str(found[-1]), header=True, enforceSchema=False)
    return nan_to_null(df), json.loads(manifest.read_text()) if manifest.exists() else {}


def read_rates(spark: SparkSession, path: str, columns: dict[str, str], skip: int = 5, date: str = "session") -> DataFrame:
    """A CSV with `skip` lines of notes before its data: first column the date, the others named by `columns` in order.

    What does not parse as a date drops the row; what does not parse as a number is NULL.
    """
    # a file of rates is small, and read as one row its lines have numbers wherever it is split
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("__n", "value")).where(F.col("__n") >= skip)
    parts = F.split("value", ",")
    rows = lines.select(
        F.to_date(F.try_to_timestamp(F.trim(parts[0]), F.lit("yyyy-MM-dd"))).alias(date),
        *(F.trim(F.get(parts, F.lit(i + 1))).try_cast("double").alias(n) for i, n in enumerate(columns.values()))
    )
    return rows.where(F.col(date).isNotNull())


def write_table(df: DataFrame, path: str, form: str = "parquet", mode: str = "overwrite", digits: int | None = None) -> None:
    """Parquet or CSV; digits: significant digits of doubles in text."""
    if digits is not None:
        df = df.select(*(F.format_string(f"%.{digits}g", c).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))
    w = df.write.mode(mode)
    w.parquet(path) if form == "parquet" else w.option("header", True).csv(path)


def write_manifest(path: str, **facts) -> None:
    Path(path).write_text(json.dumps(facts, indent=2, sort_keys=True, default=str) + "\n")


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or address, and the path on it."""
    return pafs.FileSystem.from_uri(path if urlsplit(path).scheme else f"file://{Path(path).absolute()}")


def exists(path: str) -> bool:
    fs, at = _store(path)
    return fs.get_file_info(at).type != pafs.FileType.NotFound


def write_json(path: str, facts: dict) -> None:
    """A small JSON file on any store; its folder is made."""
    fs, at = _store(path)
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(at) as f:
        f.write((json.dumps(facts, indent=2, sort_keys=True, default=str) + "\n").encode())


def deep_merge(base: dict, over: dict) -> dict:
    """Dicts merge key by key; anything else of `over` replaces."""
    out = dict(base)
    for k, v in over.items():
        out[k] = deep_merge(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v
    return out


def load_config(path: str, overlay: str | None = None) -> dict:
    """A JSON configuration (or YAML, where a YAML reader is installed), with an overlay merged in."""

    def read(p: str) -> dict:
        text = Path(p).read_text()
        if p.endswith(".json"):
            return json.loads(text)
        import yaml

        return yaml.safe_load(text) or {}

    return deep_merge(read(path), read(overlay)) if overlay else read(path)


def file_sha256(path: str) -> str:
    """SHA-256 of a file; of text files with Windows line ends as if they were plain ones."""
    data = Path(path).read_bytes()
    return hashlib.sha256(data.replace(b"\r\n", b"\n") if path.endswith(TEXT_SUFFIXES) else data).hexdigest()


def read_or_aggregate(spark: SparkSession, documents: str, aggregate: str, build, spine: DataFrame) -> DataFrame:
    """build(documents) where the documents are there, else the committed aggregate on the spine, zero-filled."""
    if exists(documents):
        return build(spark.read.parquet(documents))
    return spine.select("session").join(spark.read.parquet(aggregate), "session", "left").na.fill(0)


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.links, self.text, self._in = "", [], [], []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "title"):
            self._in.append(tag)
        if tag == "a" and (href := dict(attrs).get("href")):
            self.links.append(href)

    def handle_endtag(self, tag):
        if self._in and tag == self._in[-1]:
            self._in.pop()

    def handle_data(self, data):
        if self._in[-1:] == ["title"]:
            self.title += data
        elif not self._in:
            self.text.append(data)


def parse_page(html: Column | str) -> Column:
    """Title, links and visible text of pages, Arrow batch by batch; a null page has none."""

    @F.pandas_udf("title string, n_links int, first_link string, body string")
    def parse(pages):
        import pandas as pd

        rows = []
        for h in pages:
            p = _Page()
            p.feed(h or "")
            p.close()
            rows.append((p.title.strip() or None, len(p.links), p.links[0] if p.links else None, " ".join(" ".join(p.text).split())))
        return pd.DataFrame(rows, columns=["title", "n_links", "first_link", "body"])

    return parse(html)


class _Select(HTMLParser):
    """Elements of a tag whose class attribute has a word: their text, id and first link."""

    def __init__(self, tag: str, word: str | None):
        super().__init__(convert_charrefs=True)
        self.tag, self.word, self.found, self._depth, self._now = tag, word, [], 0, None

    def handle_starttag(self, tag, attrs):
        at = dict(attrs)
        if self._now is not None:
            self._depth += tag == self.tag
            if tag == "a" and at.get("href") and not self._now["href"]:
                self._now["href"] = at["href"]
        elif tag == self.tag and (self.word is None or self.word in (at.get("class") or "").split()):
            self._now, self._depth = {"text": [], "id": at.get("id"), "href": at.get("href")}, 1

    def handle_endtag(self, tag):
        if self._now is not None and tag == self.tag:
            self._depth -= 1
            if not self._depth:
                self._done()

    def handle_data(self, data):
        if self._now is not None:
            self._now["text"].append(data)

    def _done(self):
        self.found.append((" ".join(" ".join(self._now["text"]).split()), self._now["id"], self._now["href"]))
        self._now = None

    def close(self):
        super().close()
        if self._now is not None:  # never closed: what there is
            self._done()


def select_elements(html: Column | str, tag: str, word: str | None = None) -> Column:
    """Array of (text, id, href) of the outermost elements of a tag, with a word in their class if given; NULL pages have none."""

    @F.pandas_udf("array<struct<text: string, id: string, href: string>>")
    def select(pages):
        out = []
        for h in pages:
            p = _Select(tag, word)
            p.feed(h or "")
            p.close()
            out.append([dict(zip(("text", "id", "href"), x)) for x in p.found])
        return pd.Series(out)

    return select(html)


def new_items(found: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Found items that are not done yet, each once."""
    return found.dropDuplicates([key]).join(done.select(key).distinct(), key, "left_anti")


def seeded_sample(df: DataFrame, stratum: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows of each stratum by a seeded hash of their key: the same rows everywhere. Each task passes on its own n best of a stratum (WindowGroupLimit)."""
    from pyspark.sql import Window

    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(stratum).orderBy(order, key))).where(F.col("__rn") <= n).drop("__rn")


def synthetic_snapshot(spark: SparkSession, n: int = 600, seed: int = 7) -> DataFrame:
    """A seeded random-walk snapshot with one negative oil price and two gaps in the rates."""
    import datetime as dt

    import numpy as np

    rng = np.random.default_rng(seed)
    days, d = [], dt.date(2015, 1, 2)
    while len(days) < n:
        if d.weekday() < 5:
            days.append(d)
        d += dt.timedelta(1)
    close = 100 * np.exp(np.cumsum(rng.normal(2e-4, 0.01, n)))
    open_ = np.concatenate([[100.0], close[:-1]]) * np.exp(rng.normal(0, 0.002, n))
    spread = np.abs(rng.normal(0, 0.004, (2, n)))
    rate = 2 + 2 * np.sin(np.arange(n) / 180)
    series = {
        "open": open_, "high": np.maximum(open_, close) * (1 + spread[0]), "low": np.minimum(open_, close) * (1 - spread[1]), "close": close,
        "vix": 15 * np.exp(rng.normal(0, 0.2, n)), "dxy": 95 + np.cumsum(rng.normal(0, 0.2, n)), "tnx": rate + 0.5, "oil": 60 * np.exp(
            np.cumsum(rng.normal(0, 0.01, n))
        ),
        "qqq_close": close * np.exp(rng.normal(0, 0.01, n)), "iwm_close": close * np.exp(rng.normal(0, 0.01, n)), "dia_close": close * np.exp(rng.normal(0, 0.01, n)),
        "dgs3mo": rate, "dtb3": rate * 0.98, "dgs2": rate + 0.2, "dgs10": rate + 0.7,
    }
    series["oil_wti"] = series["oil"].copy()
    series["oil_wti"][n // 2] = -37.6
    volume = rng.integers(1_000_000, 5_000_000, n)
    rows = []
    for i, day in enumerate(days):
        half = day.month == 12 and day.day == 24
        row = {k: float(v[i]) for k, v in series.items()} | {
            "symbol": "SYN", "session": day, "volume": int(volume[i]), "session_minutes": 210 if half else 390,
            "is_half_day": int(half)
        }
        if i in (n // 3, n // 3 + 20):
            row |= dict.fromkeys(("dgs3mo", "dtb3", "dgs2", "dgs10"))
        rows.append(tuple(row[c] for c in SNAPSHOT.fieldNames()))
    return spark.createDataFrame(rows, SNAPSHOT)


def row_digest(*columns: str) -> Column:
    """SHA-256 of the columns as text, joined by |; a NULL is written as such."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in columns)), 256)
