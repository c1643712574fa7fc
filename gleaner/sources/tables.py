"""Résumé CSV, gold JSON and scaffolds; report sinks; configuration."""

from __future__ import annotations

import os
import tempfile
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GOLD = (
    "cv_id string, category string, text_file string, text string, skills array<struct<canonical:string,start:int,end:int>>, "
    "education array<struct<start:int,end:int>>, notes string"
)


def read_resume_csv(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """cv_id, category, text of a CSV with columns ID, Category, Resume_str; texts may hold line breaks and doubled quotes."""
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False)
    out = raw.select(F.col("ID").cast("string").alias("cv_id"), F.col("Category").cast("string").alias("category"), F.col("Resume_str").cast("string").alias("text"))
    return out.limit(limit) if limit is not None else out


def read_gold(spark: SparkSession, path: str, texts: DataFrame | None = None, one_array: bool = True) -> DataFrame:
    """Gold records of a file that is one JSON array, or else one record a line; text from ``texts`` (cv_id, text), or from the record; has_text tells where there is none."""
    g = spark.read.schema(GOLD).json(path, multiLine=one_array)
    if texts is not None:
        g = g.join(texts.select("cv_id", F.col("text").alias("_text")), "cv_id", "left").withColumn("text", F.coalesce("_text", "text")).drop("_text")
    return g.withColumn("has_text", F.col("text").isNotNull())


def gold_spans(gold: DataFrame, feature: str) -> DataFrame:
    """doc_id, label, start_off, end_off of skills or education."""
    s = gold.select(F.col("cv_id").alias("doc_id"), F.explode(feature).alias("x"))
    label = F.col("x.canonical") if feature == "skills" else F.lit("education")
    return s.select("doc_id", label.alias("label"), F.col("x.start").alias("start_off"), F.col("x.end").alias("end_off"))


def gold_scaffold(sample: DataFrame) -> DataFrame:
    """Records of a sample (cv_id, category, text) with empty gold."""
    kinds = dict(p.split(" ", 1) for p in GOLD.split(", "))
    return sample.select(
        "cv_id", "category", F.concat(F.lit("cv_"), F.col("cv_id"), F.lit(".txt")).alias("text_file"), "text",
        F.array().cast(kinds["skills"]).alias("skills"), F.array().cast(kinds["education"]).alias("education"), F.lit("").alias("notes"),
    )


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the checkpoint folder that the session names, removed when the driver ends; a local session may do without one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="gleaner-")
    path = f"{base.rstrip('/')}/{name}-{os.urandom(8).hex()}"
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    return path


def keep(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: what several branches of a plan use is made once, and outlives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


@dataclass(frozen=True)
class Config:
    """Settings: environment variables GLEANER_<NAME> over a mapping of secrets over these defaults."""

    max_upload_mb: float = 5.0
    parse_timeout_s: float = 15.0
    redundancy_threshold: float = 0.85
    relevance_threshold: float = 0.5
    verify_threshold: float = 0.5
    limit_calls: int = 5
    limit_seconds: int = 60
    llm_enabled: bool = False
    llm_timeout_s: float = 20.0
    llm_max_tokens: int = 1024
    llm_key: str = ""

    @classmethod
    def resolve(cls, secrets: dict[str, str] | None = None) -> Config:
        """Numbers that can't be read fall back to the default."""
        found = {}
        for f in fields(cls):
            raw = os.environ.get(f"GLEANER_{f.name.upper()}", (secrets or {}).get(f.name))
            if raw is None:
                continue
            kind = type(f.default)
            if kind is bool:
                found[f.name] = str(raw).strip().lower() in {"1", "true", "yes", "on"}
            else:
                try:
                    found[f.name] = kind(raw)
                except ValueError:
                    continue
        return cls(**found)

    def redacted(self) -> dict[str, object]:
        return {f.name: ("***" if f.name == "llm_key" and self.llm_key else getattr(self, f.name)) for f in fields(self)}
