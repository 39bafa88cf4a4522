"""Scans and sinks: feature arrays (npz), audio (WAV), JSON documents, text matrices, feature tables."""

from __future__ import annotations

import io
import json
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stimframe.operators.identity import name_key
from stimframe.operators.rank import ranked
from stimframe.sources import flac
from stimframe.sources.npz import NpzSource


def scan_binary(spark: SparkSession, path: str, glob: str, recursive: bool = False, ignore: list[str] | None = None, search: list[str] | None = None) -> DataFrame:
    """Files with content, filtered by name before a byte of content is read.

    ignore drops names with any of the strings, search keeps names with any.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    for s in ignore or []:
        files = files.where(~F.contains(name, F.lit(s)))
    if search:
        kept = F.lit(False)
        for s in search:
            kept = kept | F.contains(name, F.lit(s))
        files = files.where(kept)
    return files.withColumn("stim", name_key(F.col("path")))


def select_stimuli(spark: SparkSession, path: str, names: list[str] | None = None, recursive: bool = False) -> DataFrame:
    """Audio files, of the names if given; no file is an error. They are in no order: sorting would move their content."""
    found = scan_binary(spark, path, "*.{wav,flac}", recursive)
    if names is not None:
        found = found.where(F.col("stim").isin(names))
    if found.drop("content").isEmpty():
        raise ValueError(f"no stimuli in {path}")
    return found


def unique_stimuli(files: DataFrame) -> DataFrame:
    """files, or an error if two of them name one stimulus."""
    twice = files.groupBy("stim").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"two files are named {twice[0].stim}")
    return files


def read_features(spark: SparkSession, path: str, recursive: bool = False, ignore: list[str] | None = None, search: list[str] | None = None) -> DataFrame:
    """(stim, frame, features) of npz files: the first array of each, a row for each of its rows."""

    def load(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for stim, content in zip(part["stim"], part["content"]):
                with np.load(io.BytesIO(content), allow_pickle=False) as held:
                    m = held[held.files[0]]
                m = m.reshape(len(m), -1) if m.ndim else m.reshape(1, 1)
                for at in range(0, len(m), 10_000):
                    rows = m[at : at + 10_000].astype(float)
                    yield pd.DataFrame({"stim": stim, "frame": np.arange(at, at + len(rows), dtype=np.int32), "features": list(rows)})

    return scan_binary(spark, path, "*.npz", recursive, ignore, search).select("stim", "content").mapInPandas(load, "stim string, frame int, features array<double>")


def with_times(features: DataFrame, times: DataFrame) -> DataFrame:
    """features with t_start and t_end of the times' two columns, by stimulus and frame."""
    t = times.select("stim", "frame", F.col("features")[0].alias("t_start"), F.col("features")[1].alias("t_end"))
    return features.join(t, ["stim", "frame"])


def drop_loudness(features: DataFrame) -> DataFrame:
    """Articulatory features without their thirteenth channel; an error unless 13 are left."""
    from stimframe.operators.vectors import drop_channel

    return features.withColumn("features", drop_channel(F.col("features"), 12, 13))


def _samples(content: bytes) -> tuple[int, np.ndarray]:
    """Rate and samples, (n, channels) within -1 and 1, of a WAV or FLAC file."""
    if content[:4] == b"fLaC":
        own, depth, x = flac.decode(content)
        return own, x / float(1 << (depth - 1))
    with wave.open(io.BytesIO(content)) as w:
        width, channels, own, raw = w.getsampwidth(), w.getnchannels(), w.getframerate(), w.readframes(w.getnframes())
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / float(1 << 23)
    else:
        x = np.frombuffer(raw, f"<i{width}").astype(float) / float(1 << (8 * width - 1))
    return own, x.reshape(-1, channels)


def read_audio(files: DataFrame, rate: int = 16_000, keep_failed: bool = False) -> DataFrame:
    """(stim, sample_rate, waveform) of mono or mixed-down PCM WAV and FLAC files, resampled.

    Files that can't be decoded are left out, or with keep_failed have no waveform, and the reason in a column error.
    """
    from stimframe.functions.signal import resample

    def decode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for stim, content in zip(part["stim"], part["content"]):
                try:
                    own, x = _samples(bytes(content))
                except (wave.Error, EOFError, ValueError) as e:
                    yield pd.DataFrame({"stim": [stim], "sample_rate": [rate], "waveform": [None], "error": [str(e) or "the file ends early"]})
                    continue
                yield pd.DataFrame({"stim": [stim], "sample_rate": [rate], "waveform": [resample(x.mean(1), own, rate).astype(np.float32)], "error": [None]})

    found = files.select("stim", "content").mapInPandas(decode, "stim string, sample_rate int, waveform array<float>, error string")
    return found if keep_failed else found.where("error is null").drop("error")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(token, idx) of a JSON object of tokens."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,int>")).alias("token", "idx"))


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """(split, stim, role) of a JSON list of objects with train, val and test."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.posexplode(F.from_json("value", "array<map<string,array<string>>>")).alias("split", "roles"))
    return rows.select("split", F.explode("roles").alias("role", "stims")).select("split", F.explode("stims").alias("stim"), "role")


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(place, row) of the rows of a text matrix whose first line gives its shape; place is a row's 0-based number in the file.

    Lines are numbered by the block of the file that they are read with and their order there, so that a file of any size is read in
    blocks, once.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_block_start").alias("__b"), F.monotonically_increasing_id().alias("__m")).where(F.trim("value") != "")
    numbered = ranked(lines, [], [F.col("__f"), F.col("__b"), F.col("__m")], "place").where("place > 0")
    return numbered.select((F.col("place") - 1).alias("place"), F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("double")).alias("row"))


def write_features(features: DataFrame, path: str, by: tuple[str, ...] = ("family", "module")) -> None:
    """Feature rows as Parquet, a folder for each family and module; those present in features are replaced, others stay."""
    features.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def missing_work(work: DataFrame, done: DataFrame | None, key: str = "stim", overwrite: bool = False) -> DataFrame:
    """The part of a work list without a result yet."""
    return work if overwrite or done is None else work.join(done.select(key).distinct(), key, "left_anti")


def copy_times(times: DataFrame, wanted: DataFrame, key: str = "stim") -> DataFrame:
    return times.join(wanted.select(key).distinct(), key, "left_semi")


def read_results(spark: SparkSession, path: str, dimensions: dict[str, int], recursive: bool = True) -> DataFrame:
    """Result files (JSON objects of numbers or lists of numbers) as rows: dimensions from the parts of the path, metric, dim (NULL for a single number) and value."""
    from stimframe.operators.identity import path_part

    text = spark.read.option("recursiveFileLookup", str(recursive).lower()).text(path, wholetext=True).withColumn("__path", F.col("_metadata.file_path"))
    named = text.select(*[path_part(F.col("__path"), place).alias(name) for name, place in dimensions.items()], F.explode(F.from_json("value", "map<string,string>")).alias("metric", "__v"))
    lists = F.when(F.startswith(F.col("__v"), F.lit("[")), F.from_json("__v", "array<double>", {"allowNonNumericNumbers": "true"}))
    single = F.array(F.col("__v").try_cast("double"))
    rows = named.withColumn("__l", F.coalesce(lists, single)).withColumn("__many", lists.isNotNull())
    return rows.select(*dimensions, "metric", F.posexplode("__l").alias("__dim", "value"), "__many").select(*dimensions, "metric", F.when(F.col("__many"), F.col("__dim")).alias("dim"), "value")


def write_identities(df: DataFrame, path: str, parts: tuple[str, ...] = ("tokens", "targets", "times")) -> None:
    """The parts of aligned annotations as Parquet folders beside each other, each with stim and seq; earlier ones are replaced."""
    for part in parts:
        df.select("stim", "seq", *([part] if part != "times" else ["t_start", "t_end"])).write.mode("overwrite").parquet(f"{path}/{part}")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def _write_parts(df: DataFrame, path: str, parts: list[dict], order: str, mode: str) -> None:
    df.sparkSession.dataSource.register(NpzSource)
    columns = list(dict.fromkeys(p["column"] for p in parts))
    ready = df.select("stim", order, *columns).repartition("stim").sortWithinPartitions("stim", order)
    ready.write.format("npz").option("path", path).option("parts", json.dumps(parts)).mode(mode).save()


def write_npz(features: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Write each stimulus's frames as <stim>.npz under a folder that all executors share, all or none; returns (stim, n_frames).

    mode "append" replaces the files of these stimuli, "overwrite" deletes those of others too.
    """
    _write_parts(features, path, [{"column": "features", "suffix": "", "name": "features"}], "frame", mode)
    return features.groupBy("stim").agg(F.count(F.lit(1)).alias("n_frames"))


def write_aligned(df: DataFrame, path: str, mode: str = "append") -> None:
    """Aligned annotations as four npz files for each stimulus: pooled features, _idtargets, _regtargets and _times, all or none.

    df has stim, seq, pooled (array), token_id, targets (array), t_start and t_end; the rows of the four files of a stimulus are the same annotations in order of seq.
    """
    parts = [{"column": c, "suffix": s, "name": ""} for c, s in (("pooled", ""), ("token_id", "_idtargets"), ("targets", "_regtargets"), ("times", "_times"))]
    _write_parts(df.withColumn("times", F.array("t_start", "t_end")), path, parts, "seq", mode)
