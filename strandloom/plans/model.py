"""A trained model: trees, segments, alphabet, and how counts are stored."""

from __future__ import annotations

import json
import logging
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.alphabet import Alphabet
from strandloom.functions.sequence import contigs
from strandloom.operators.counting import count_chunks, count_segments, stored
from strandloom.operators.selection import LabelScaler
from strandloom.plans import boosting
from strandloom.plans.lineage import cut, spread
from strandloom.plans.results import SegmentImportance
from strandloom.sources.fasta import fasta_chunks, fasta_paths

log = logging.getLogger("strandloom")
VERSION = 1


class SegmentModel:
    def __init__(self, spark: SparkSession, nodes: list[tuple], base: np.ndarray, segments: list[str], importance: list[float], alphabet: Alphabet, labels: list[str], *, binary=False, sparse=False, uint16=False, binary_features=False, keep_unknown=False, scaler: LabelScaler | None = None) -> None:
        self.spark, self.nodes, self.base = spark, nodes, np.asarray(base, dtype=float)
        self.segments, self.importance, self.alphabet, self.labels = segments, importance, alphabet, labels
        self.binary, self.sparse, self.uint16, self.binary_features, self.keep_unknown, self.scaler = binary, sparse, uint16, binary_features, keep_unknown, scaler

    @property
    def segment_importance(self) -> SegmentImportance:
        rows = [(i, s, float(v)) for i, (s, v) in enumerate(zip(self.segments, self.importance, strict=True))]
        return SegmentImportance(self.spark.createDataFrame(rows, "seg_id long, Segment string, Importance double"))

    def _pool(self) -> DataFrame:
        bad = [s for s in self.segments if not self.alphabet.fits(s)]
        if bad:
            raise ValueError(f"segments outside the alphabet: {bad[:5]}")
        return self.spark.createDataFrame(list(enumerate(self.segments)), "seg_id long, segment string")

    def count(self, samples: DataFrame, id_column: str = "sample_id", text_column: str = "text") -> DataFrame:
        """``sample_id, seg_id, n`` of a table of texts, zeros left out. Contigs are parsed and stored once, on all cores even where the table is one file."""
        nodes = cut(contigs(spread(samples.select(id_column, text_column)), self.alphabet, id_column=id_column, text_column=text_column, keep_unknown=self.keep_unknown))
        return self._stored(count_segments(nodes, self._pool(), self.alphabet))

    def count_files(self, paths: list[str] | str, glob: str | None = None) -> DataFrame:
        """The same of sequence files, read in byte ranges; ``sample_id`` is the path."""
        longest = max((len(s) for s in self.segments), default=1)
        chunks = fasta_chunks(self.spark, paths, self.alphabet, longest - 1, keep_unknown=self.keep_unknown, glob=glob).withColumnRenamed("item", "sample_id")
        return self._stored(count_chunks(chunks, self._pool(), self.alphabet))

    def _stored(self, counts: DataFrame) -> DataFrame:
        return counts.select("sample_id", "seg_id", stored("n", uint16=self.uint16, presence=self.binary_features).alias("n"))

    def predict_table(self, samples: DataFrame, id_column: str = "sample_id", text_column: str = "text") -> DataFrame:
        """``sample_id`` and ``prediction`` (or ``prediction_<label>``) for every row; ids must be distinct."""
        return self._scored(samples.select(F.col(id_column).alias("sample_id")), self.count(samples, id_column, text_column))

    def predict_files(self, paths: list[str] | str, glob: str | None = None) -> DataFrame:
        """``sample_id`` (the path) and predictions of sequence files, or of the files of a folder."""
        return self._scored(fasta_paths(self.spark, paths, glob).select(F.col("item").alias("sample_id")), self.count_files(paths, glob))

    def _scored(self, ids: DataFrame, counts: DataFrame) -> DataFrame:
        packed = counts.groupBy("sample_id").agg(F.collect_list(F.struct(F.col("seg_id").alias("i"), F.col("n").cast("float").alias("n"))).alias("c"))
        rows = ids.join(packed, "sample_id", "left").select("sample_id", F.transform("c", lambda x: x["i"]).alias("i"), F.transform("c", lambda x: x["n"]).alias("n"))
        names = ["prediction"] if len(self.labels) == 1 else [f"prediction_{n}" for n in self.labels]
        used = sorted({n[3] for n in self.nodes if n[3] is not None})
        place = {c: k for k, c in enumerate(used)}
        nodes = [n if n[3] is None else (*n[:3], place[n[3]], *n[4:]) for n in self.nodes]  # only columns that trees look at
        base, binary, missing, width = self.base, self.binary, self.sparse, len(used)
        means, stds = (self.scaler.means, self.scaler.stds) if self.scaler else (0.0, 1.0)

        def run(frames):
            for pdf in frames:
                for at in range(0, max(len(pdf), 1), 1024):
                    part = pdf.iloc[at : at + 1024]
                    x = np.zeros((len(part), max(width, 1)), dtype=np.float32)
                    for r, (i, n) in enumerate(zip(part["i"], part["n"], strict=True)):
                        if i is not None:
                            for c, v in zip(i, n, strict=True):
                                if c in place:
                                    x[r, place[c]] = v
                    y = boosting.predict(x, nodes, base, binary, missing) * stds + means
                    yield pd.DataFrame({"sample_id": part["sample_id"], **{n: y[:, k] for k, n in enumerate(names)}})

        kind = rows.schema["sample_id"].dataType.simpleString()
        return rows.mapInPandas(run, f"sample_id {kind}, " + ", ".join(f"`{n}` double" for n in names))

    def _collected(self, df: DataFrame, n: int) -> np.ndarray:
        pdf = df.orderBy("sample_id").toPandas()
        out = pdf.drop(columns="sample_id").to_numpy()
        assert len(out) == n
        return out[:, 0] if len(self.labels) == 1 else out

    def predict_sequences(self, texts: list[str]) -> np.ndarray:
        """Predictions of driver-side texts in their order, one column per label if there are several."""
        return self._collected(self.predict_table(self.spark.createDataFrame(list(enumerate(texts)), "sample_id long, text string")), len(texts))

    def predict(self, files: list[str]) -> np.ndarray:
        """Predictions of sequence files in their order; a row a file comes to the driver."""
        names = [f if f.startswith("/") or "://" in f else str(Path(f).absolute()) for f in files]
        scored = {r[0]: r[1:] for r in self.predict_files(sorted(set(names))).collect()}
        out = np.array([scored[n] for n in names], dtype=float)
        return out[:, 0] if len(self.labels) == 1 else out

    def metadata(self) -> dict:
        return {
            "version": VERSION, "alphabet": self.alphabet.to_dict(), "count_dtype": "uint16" if self.uint16 else "float32", "sparse": self.sparse, "binary_features": self.binary_features, "binary": self.binary, "keep_unknown": self.keep_unknown,
            "label_names": self.labels, "label_scaler": self.scaler.to_dict() if self.scaler else None, "base": self.base.tolist(),
        }

    def save(self, prefix: str) -> tuple[str, str, str]:
        """``<prefix>.json`` (trees), ``_segs.csv`` and ``_meta.json``; returns the three paths."""
        Path(prefix).parent.mkdir(parents=True, exist_ok=True)
        paths = f"{prefix}.json", f"{prefix}_segs.csv", f"{prefix}_meta.json"
        Path(paths[0]).write_text(json.dumps({"columns": boosting.NODE_COLUMNS, "nodes": self.nodes}))
        pd.DataFrame({"Segment": self.segments, "Importance": self.importance}).to_csv(paths[1], index=False)
        Path(paths[2]).write_text(json.dumps(self.metadata()))
        return paths

    def save_table(self, path: str) -> None:
        """The model under ``path``, written by Spark, so the path may be remote: ``trees`` and ``segments`` as Parquet, ``about`` as JSON."""
        trees = [(i, *n) for i, n in enumerate(self.nodes)]
        self.spark.createDataFrame(trees, f"i int, {boosting.NODE_SCHEMA}").coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
        self.segment_importance.table.write.mode("overwrite").parquet(f"{path}/segments")
        self.spark.createDataFrame([(json.dumps(self.metadata()),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    @classmethod
    def load_table(cls, spark: SparkSession, path: str) -> SegmentModel:
        """What ``save_table`` wrote. Trees and segments come to the driver; their numbers are bounded by the settings of the run."""
        m = json.loads(spark.read.text(f"{path}/about").first()[0])
        trees = spark.read.parquet(f"{path}/trees").orderBy("i").select(*boosting.NODE_COLUMNS).collect()
        segments = spark.read.parquet(f"{path}/segments").orderBy("seg_id").collect()
        return cls._of(spark, m, [tuple(t) for t in trees], [r["Segment"] for r in segments], [r["Importance"] for r in segments])

    @classmethod
    def load(cls, spark: SparkSession, prefix: str) -> SegmentModel:
        nodes = [tuple(n) for n in json.loads(Path(f"{prefix}.json").read_text())["nodes"]]
        segs = pd.read_csv(f"{prefix}_segs.csv", dtype={"Segment": str}, keep_default_na=False)
        meta_path = Path(f"{prefix}_meta.json")
        if meta_path.exists():
            m = json.loads(meta_path.read_text())
        else:
            log.warning("%s is missing; the defaults of a DNA regression are taken", meta_path)
            m = {"alphabet": None, "label_names": ["labels"], "base": [0.0]}
        return cls._of(spark, m, nodes, segs["Segment"].tolist(), segs["Importance"].astype(float).tolist())

    @classmethod
    def _of(cls, spark: SparkSession, m: dict, nodes: list[tuple], segments: list[str], importance: list[float]) -> SegmentModel:
        return cls(
            spark, nodes, np.array(m["base"]), segments, importance, Alphabet.from_dict(m["alphabet"]), m["label_names"], binary=m.get("binary", False), sparse=m.get("sparse", False),
            uint16=m.get("count_dtype") == "uint16", binary_features=m.get("binary_features", False), keep_unknown=m.get("keep_unknown", False), scaler=LabelScaler.from_dict(m.get("label_scaler")),
        )
