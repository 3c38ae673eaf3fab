"""Reading corpora: the catalogue, relation-corpus files and stored splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from graphloom.operators.topology import ordinals
from graphloom.session import children
from graphloom.sources.arrays import read_array

# The known corpora and the files of the local one.
SPECS = [
    {"dataset_id": "docred", "display_name": "DocRED", "task_type": "relation_extraction", "source": "local",
     "hf_name": None, "hf_config": None, "trust_remote_code": False,
     "description": "Relation extraction: a title or relation hint as goal, article sentences as text."},
    {"dataset_id": "fever", "display_name": "FEVER", "task_type": "fact_verification", "source": "hf",
     "hf_name": "fever", "hf_config": "v1.0", "trust_remote_code": True,
     "description": "Fact checking: decide from encyclopedia evidence whether a claim holds."},
    {"dataset_id": "cuad", "display_name": "CUAD", "task_type": "legal_compliance", "source": "hf",
     "hf_name": "chenghao/cuad_qa", "hf_config": None, "trust_remote_code": True,
     "description": "Contract questions: find the answer to a clause question in a long contract."},
    {"dataset_id": "scifact", "display_name": "SciFact", "task_type": "scientific_evidence", "source": "hf",
     "hf_name": "scifact", "hf_config": "claims", "trust_remote_code": True,
     "description": "Scientific evidence: support or refute a claim from paper abstracts."},
]
DOCRED_FILES = {
    "train_annotated": "train_annotated.json",
    "train_distant": "train_distant.json",
    "dev": "dev.json",
    "test": "test.json",
}
FALLBACK_SPLITS = {"cuad": ["train", "test"]}
COMMON_SPLITS = ["train", "validation", "test"]

SPEC_SCHEMA = (
    "dataset_id string, display_name string, task_type string, source string, hf_name string, hf_config string, "
    "trust_remote_code boolean, description string"
)
DOCRED_SAMPLE = (
    "title string, abstract string, sents array<array<string>>, "
    "vertexSet array<array<struct<name:string,type:string,sent_id:int,pos:array<int>>>>, "
    "labels array<struct<r:string,h:int,t:int,evidence:array<int>>>"
)


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(s.values()) for s in SPECS], SPEC_SCHEMA)


def spec(dataset_id: str) -> dict:
    for entry in SPECS:
        if entry["dataset_id"] == dataset_id:
            return entry
    raise KeyError(f"unknown dataset: {dataset_id}")


def read_docred(spark: SparkSession, root: str, split: str) -> DataFrame:
    """Samples of a local split with their file position ``idx``.

    The file is one JSON array, or an object whose ``data`` is that array, and is read by as many tasks as it has
    splits; anything else raises.
    """
    if split not in DOCRED_FILES:
        raise KeyError(f"unknown split: {split}")
    path = f"{root}/{DOCRED_FILES[split]}"
    try:
        return read_array(spark, path, DOCRED_SAMPLE).drop("file")
    except AnalysisException as error:
        raise FileNotFoundError(path) from error


def split_path(root: str, dataset_id: str, split: str, config: str | None = None) -> str:
    folder = f"{root}/{dataset_id}/{config}" if config else f"{root}/{dataset_id}"
    return f"{folder}/split={split}"


def read_split(spark: SparkSession, root: str, dataset_id: str, split: str) -> DataFrame:
    """A stored split; rows without a stored ``idx`` are numbered by file and row position."""
    entry = spec(dataset_id)
    path = split_path(root, dataset_id, split, entry["hf_config"])
    try:
        rows = spark.read.parquet(path)
    except AnalysisException as error:
        raise RuntimeError(f"cannot load dataset={dataset_id}, config={entry['hf_config']}, split={split}") from error
    return rows if "idx" in rows.columns else with_index(rows)


def with_index(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Stable positions ``idx`` in file order, counted per file chunk and then added up."""
    names = rows.columns
    place = rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    keys = keys or []
    if not keys:
        place, keys = place.withColumn("__all", F.lit(0)), ["__all"]
    chunk = [F.col("__file"), F.floor(F.col("__at") / 65536)]
    return ordinals(place, keys, F.col("__file"), chunk, [F.col("__at")], "idx").select(*names, "idx")


def list_splits(spark: SparkSession, root: str, dataset_id: str) -> DataFrame:
    """Splits of a corpus: fixed for the local one, else the stored folders, else the usual names."""
    entry = spec(dataset_id)
    if entry["source"] == "local":
        names = list(DOCRED_FILES)
    else:
        config = entry["hf_config"]
        folder = f"{root}/{dataset_id}/{config}" if config else f"{root}/{dataset_id}"
        stored = [n.partition("=")[2] for n in children(spark, folder) if n.startswith("split=")]
        names = stored or FALLBACK_SPLITS.get(dataset_id, COMMON_SPLITS)
    return spark.createDataFrame([(n,) for n in names], "split string")
