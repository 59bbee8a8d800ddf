"""Writers. Tables are written by Spark's committer; small single files by the driver, whole or not at all."""

from __future__ import annotations

import csv
import io
import json
import math
import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_text(path: str, text: str) -> None:
    """Writes beside the path, syncs and renames: readers see the old file or the new one."""
    half = f"{path}.{uuid.uuid4().hex}.part"
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    try:
        with open(half, "w", encoding="utf-8", newline="") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(half, path)
    finally:
        if os.path.exists(half):
            os.remove(half)


def write_json(path: str, value, strict: bool = True, indent: int = 2) -> bool:
    """Sorted keys, no NaN, a line end. Unless strict, a failure is reported by False."""
    try:
        write_text(path, json.dumps(value, sort_keys=True, allow_nan=False, indent=indent, ensure_ascii=False) + "\n")
    except (OSError, ValueError, TypeError):
        if strict:
            raise
        return False
    return True


def json_safe(value):
    """Non-finite numbers as null, sets sorted, rows as objects."""
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return {str(getattr(k, "value", k)): json_safe(v) for k, v in value.items()}
    if isinstance(value, (set, frozenset)):
        return [json_safe(v) for v in sorted(value)]
    if isinstance(value, (list, tuple)):
        return [json_safe(v) for v in value]
    return getattr(value, "value", value)


def write_csv(path: str, rows: list[dict], columns: list[str], sep: str = ",") -> None:
    out = io.StringIO()
    writer = csv.DictWriter(out, columns, delimiter=sep, extrasaction="ignore", lineterminator="\n")
    writer.writeheader()
    writer.writerows(rows)
    write_text(path, out.getvalue())


def write_lines(df: DataFrame, folder: str, sep: str, *columns: str, header: bool = False) -> None:
    """An alignment as text, in order of `_pos`, by range partitions: the parts in order of their names are the whole file."""
    rows = df.sort("_pos") if "_pos" in df.columns else df
    rows.select(*[F.col(c).cast("string") for c in columns]).write.mode("errorifexists").option("sep", sep).option("header", header).option("quote", "").csv(folder)


def write_alignment(df: DataFrame, folder: str) -> None:
    """The five columns as pipe text, tab text and a scored tab table."""
    columns = ["source", "target", "relation", "confidence", "type"]
    write_lines(df, f"{folder}/alignment.txt", "|", *columns)
    write_lines(df, f"{folder}/alignment.tsv", "\t", *columns)
    named = df.select(F.col("source").alias("SrcEntity"), F.col("target").alias("TgtEntity"), F.col("confidence").alias("Score"), *(["_pos"] if "_pos" in df.columns else []))
    write_lines(named, f"{folder}/scored.tsv", "\t", "SrcEntity", "TgtEntity", "Score", header=True)


def write_annotated(df: DataFrame, folder: str, bidirectional: bool = False) -> None:
    """The annotated rows: pipe text without header, and tab text with header and confidence."""
    columns = ["source", "target", "relation", "confidence", "type", "annotation", *(["annotation_forward", "annotation_reverse"] if bidirectional else [])]
    write_lines(df, f"{folder}/annotated.txt", "|", *columns)
    write_lines(df, f"{folder}/annotated.tsv", "\t", *columns, "annotation_confidence", header=True)


def write_false_mappings(df: DataFrame, folder: str) -> None:
    write_lines(df, folder, ",", "source", "target", "oracle_prediction", "oracle_confidence", "in_reference", "error_type", header=True)


def write_documents(documents: dict[str, object], folder: str) -> list[str]:
    """A JSON file for each name; a file with other content is not overwritten."""
    out = []
    for name, value in sorted(documents.items()):
        path = f"{folder}/{name}.json"
        text = json.dumps(value, sort_keys=True, allow_nan=False, indent=2, ensure_ascii=False) + "\n"
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                if f.read() != text:
                    raise FileExistsError(path)
        else:
            write_text(path, text)
        out.append(path)
    return out


def write_vectors(df: DataFrame, folder: str, key: str) -> str:
    """Vectors under the key of what they were made from."""
    path = f"{folder}/{key}"
    df.write.mode("overwrite").parquet(path)
    return path


def read_vectors(spark, folder: str, key: str, ids: DataFrame) -> DataFrame | None:
    """The vectors of that key if they are there for exactly these ids, else None: then they are made again."""
    from pyspark.errors import AnalysisException

    try:
        df = spark.read.parquet(f"{folder}/{key}")
    except AnalysisException:
        return None
    off = df.select("id").join(ids.select("id").withColumn("_in", F.lit(True)), "id", "full_outer").where("_in IS NULL").union(ids.select("id", F.lit(True).alias("_in")).join(df.select("id"), "id", "left_anti"))
    return None if off.limit(1).count() else df


def write_ranking(path: str, questions: DataFrame, prompts: DataFrame, most: int, seed: int) -> None:
    """The questions that have a prompt, with their prompts, as one JSON document; `most` bounds what the driver holds."""
    rows = questions.join(prompts.where("direction = 'forward'").select("source", "target", "prompt"), ["source", "target"]).orderBy("source", "target").limit(2 * most).collect()
    write_json(path, {"schema": 1, "max_anchors": most, "seed": seed, "questions": [json_safe(r) for r in rows]})


def read_ranking(spark, path: str) -> DataFrame:
    whole = spark.read.option("multiLine", True).json(path)
    return whole.select(F.explode("questions").alias("q")).select("q.*")
