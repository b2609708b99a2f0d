"""Reading documents: whole files by extension, page lines that repeat or number pages, and configuration."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.chunkers import STRATEGIES
from . import formats

MOST_BYTES = 50 * 1024 * 1024
PARSED = ("pdf", "docx", "doc")
# Lines that only number a page.
PAGE_NUMBER = r"^\s*[-–—]?\s*\d+\s*(?:[-–—]|of\s+\d+)?\s*$"


def read_files(spark: SparkSession, path: str, pdf: Callable[[bytes], list[str]] = formats.pdf_pages, docx: Callable[[bytes], str | None] = formats.docx_text) -> DataFrame:
    """Files of at most 50 MB with text: (doc_id, filename, extension, size, text). A PDF's pages are joined without running lines and
    page numbers; a DOCX file's paragraphs are joined, and one that can't be read is decoded like any other file: by its byte order mark, as
    UTF-8, or else as Latin-1. A name without a dot counts as txt. pdf and docx may be other readers of one file's bytes."""
    raw = spark.read.format("binaryFile").load(path).filter(F.col("length") <= MOST_BYTES)
    name = F.element_at(F.split("path", "/"), -1)
    extension = F.when(F.contains(name, F.lit(".")), F.lower(F.element_at(F.split(name, r"\."), -1))).otherwise(F.lit("txt"))
    files = raw.select(F.xxhash64("path").alias("doc_id"), name.alias("filename"), extension.alias("extension"), F.col("length").alias("size"), "content")

    @F.pandas_udf("string")
    def parsed(extension, content):
        def one(kind, data):
            if data is None:
                return None
            return formats.join_pages(pdf(data), PAGE_NUMBER) if kind == "pdf" else docx(data)

        return extension.combine(content, one)

    content, mark = F.col("content"), F.hex(F.substring("content", 1, 3))
    marked = F.when(mark == "EFBBBF", F.try_validate_utf8(F.substring(content, 4, MOST_BYTES).cast("string"))).when(F.startswith(mark, F.lit("FFFE")) | F.startswith(mark, F.lit("FEFF")), F.decode(content, "UTF-16"))
    decoded = F.coalesce(marked, F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))
    rich = F.when(F.col("extension").isin(*PARSED), content)  # other files' bytes don't go to Python
    return files.select("doc_id", "filename", "extension", "size", F.coalesce(parsed("extension", rich), decoded).alias("text")).filter(tx.strip(F.col("text")) != "")


def without_page_numbers(text: Column) -> Column:
    return F.array_join(F.filter(tx.lines(text), lambda x: ~x.rlike(PAGE_NUMBER)), "\n")


def repeated_lines(pages: DataFrame, share: float = 0.6) -> DataFrame:
    """pages(doc_id, page, text) -> (doc_id, line): of the first and last three full lines of every page, those of at most twelve
    words that stand on at least two pages and on a share of the document's."""
    ls = tx.full_lines(F.col("text"))
    edge = F.when(F.size("ls") <= 6, F.col("ls")).otherwise(F.concat(F.slice("ls", 1, 3), F.slice("ls", -3, 3)))
    edges = pages.select("doc_id", "page", ls.alias("ls")).select("doc_id", "page", F.explode(F.array_distinct(edge)).alias("line")).filter(tx.n_words(F.col("line")) <= 12)
    total = pages.groupBy("doc_id").agg(F.count_distinct("page").alias("n"))
    counted = edges.groupBy("doc_id", "line").agg(F.count_distinct("page").alias("k")).join(total, "doc_id")
    return counted.filter(F.col("k") >= F.greatest(F.lit(2.0), F.col("n") * share)).select("doc_id", "line")


def strip_repeated_lines(pages: DataFrame) -> DataFrame:
    """pages without their repeated lines."""
    each = pages.select("doc_id", "page", F.posexplode(tx.lines(F.col("text"))).alias("pos", "raw")).withColumn("line", tx.strip(F.col("raw")))
    kept = each.join(repeated_lines(pages), ["doc_id", "line"], "left_anti")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "raw"))), lambda x: x["raw"]), "\n")
    return pages.select("doc_id", "page").join(kept.groupBy("doc_id", "page").agg(text.alias("text")), ["doc_id", "page"], "left").select("doc_id", "page", F.coalesce("text", F.lit("")).alias("text"))


METRICS = ("jsd", "hellinger", "hybrid", "pmi", "depth", "drift")


@dataclass(frozen=True)
class Config:
    """Parameters; unknown names are refused, numbers are brought into their ranges, an unknown metric or strategy is the default."""

    n_min: int = 80
    n_max: int = 500
    overlap_tokens: int = 0
    tau_jsd_low: float = 0.15
    tau_jsd_high: float = 0.45
    tau_sem: float = 0.75
    max_iterations: int = 30
    alpha: float = 0.4
    beta: float = 0.4
    hybrid_lambda: float = 0.6
    chunking_strategy: str = "auto"
    entropy_metric: str = "hybrid"
    domain_keywords: dict = field(default_factory=dict)

    # The least and the greatest value.
    RANGES = {"n_min": (20, 400), "n_max": (80, 1200), "tau_jsd_low": (0.01, 0.6), "tau_jsd_high": (0.05, 0.95), "tau_sem": (0.2, 0.99), "max_iterations": (1, 30), "alpha": (0.0, 1.0), "beta": (0.0, 1.0), "hybrid_lambda": (0.0, 1.0)}

    def updated(self, **given) -> "Config":
        """Defaults < file < call: each layer by one call. A number that can't be read is left as it was."""
        known = {f.name for f in fields(self)}
        if unknown := set(given) - known:
            raise ValueError(f"unknown parameters: {sorted(unknown)}")
        for k, (lo, hi) in self.RANGES.items():
            if k in given:
                try:
                    given[k] = type(getattr(self, k))(min(hi, max(lo, float(given[k]))))
                except (TypeError, ValueError):
                    del given[k]
        for k, allowed in (("entropy_metric", METRICS), ("chunking_strategy", (*STRATEGIES, "auto"))):
            if k in given:
                given[k] = str(given[k]).lower() if str(given[k]).lower() in allowed else getattr(Config(), k)
        new = replace(self, **given)
        return replace(new, tau_jsd_high=new.tau_jsd_low + 0.1) if new.tau_jsd_low >= new.tau_jsd_high else new

    @classmethod
    def from_yaml(cls, spark: SparkSession, path: str, key: str = "pipeline") -> "Config":
        """The parameters under a key of a YAML file, read through Spark, so that any store will do; names it doesn't know are skipped. A
        missing file, or one that holds no table, gives the defaults."""
        import yaml

        try:
            rows = spark.read.text(path, wholetext=True).collect()  # one small file
            given = yaml.safe_load(rows[0][0]) if rows else None
        except (AnalysisException, yaml.YAMLError):
            given = None
        given = given.get(key) if isinstance(given, dict) else None
        known = {f.name for f in fields(cls)}
        return cls().updated(**{k: v for k, v in (given if isinstance(given, dict) else {}).items() if k in known})


def newest(history: DataFrame, keys: list[str], order: str, most: int = 200) -> DataFrame:
    """The last `most` rows of every key, as the stores keep them."""
    return history.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).filter(F.col("_r") <= most).drop("_r")
