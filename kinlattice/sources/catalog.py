"""Run folders: input, working and output, and a JSON record of what ran and what came before."""

from __future__ import annotations

import json
import shutil
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import TableError

# fixed values: facts that a new run takes over from the one it follows
INHERITED = ["version", "model", "seed", "alt_cutoff", "allow_horizontal_transfer"]
RECORD = "run_parameters.json"
SCHEMA = "calc_status string, calc_type string, version string, model string, seed string, creation_time double, completion_time double, events array<map<string,string>>, previous_entries array<map<string,string>>"


class Run:
    """A run folder. Statuses: empty, running, crashed, complete."""

    def __init__(self, path: str, calc_type: str = "", overwrite: bool = False, previous: Run | None = None, seed: str | None = None):
        self.path = Path(path)
        record = self.path / RECORD
        if record.exists() and not overwrite and not calc_type:
            self.facts = json.loads(record.read_text())
            return
        if self.path.exists():
            if not overwrite:
                raise TableError(f"{path} is there already")
            shutil.rmtree(self.path)
        for d in ("input", "working", "output"):
            (self.path / d).mkdir(parents=True)
        self.facts = {"calc_status": "running", "calc_type": calc_type, "creation_time": time.time(), "events": [], "previous_entries": []}
        if previous is not None:
            self.facts |= {k: previous.facts[k] for k in INHERITED if k in previous.facts}
            old = {k: str(v) for k, v in previous.facts.items() if k not in ("previous_entries", "events")} | {"calc_dir": str(previous.path)}
            self.facts["previous_entries"] = [*previous.facts.get("previous_entries", []), old]
            for f in (previous.path / "output").glob("*"):
                if f.is_file():
                    shutil.copy(f, self.path / "input")
        if seed:
            self.facts["seed"] = seed
        self.write()

    @property
    def status(self) -> str:
        return self.facts.get("calc_status", "empty")

    @property
    def tree_prefix(self) -> str | None:
        kind = self.facts.get("calc_type", "")
        return "reconciled" if kind.startswith("reconcile") else "gene" if kind.startswith("ml_") else None

    def write(self) -> None:
        (self.path / RECORD).write_text(json.dumps(self.facts, indent=1, default=str))

    def update(self, key: str, value: object) -> None:
        self.facts[key] = value
        self.write()

    def event(self, description: str, **more: object) -> None:
        self.facts["events"].append({"description": description, "time": str(time.time())} | {k: str(v) for k, v in more.items()})
        self.write()

    def stash(self, source: str, to: str = "output", name: str | None = None) -> str:
        target = self.path / to / (name or Path(source).name)
        (shutil.copytree if Path(source).is_dir() else shutil.copy)(source, target)
        return str(target)

    def check_required(self, facts: list[str] = (), files: list[str] = ()) -> None:
        lacking = [k for k in facts if k not in self.facts] + [f for f in files if not (self.path / "input" / f).exists()]
        if lacking:
            raise TableError(f"the run lacks {lacking}")

    def finalize(self, successful: bool = True) -> None:
        self.facts |= {"calc_status": "complete" if successful else "crashed", "completion_time": time.time()}
        self.write()


def next_folder(parent: str, name: str) -> str:
    """'NN_name' with the number after the largest that parent holds."""
    used = [int(p.name[:2]) for p in Path(parent).glob("[0-9][0-9]_*")]
    return str(Path(parent) / f"{max(used, default=-1) + 1:02d}_{name}")


def read_runs(spark: SparkSession, pattern: str) -> DataFrame:
    """One row a record below a folder or pattern, with its path."""
    return spark.read.schema(SCHEMA).json(pattern, multiLine=True).select("*", F.regexp_replace(F.col("_metadata.file_path"), f"/{RECORD}$", "").alias("path"))


def latest(runs: DataFrame, by: list[str] = ("calc_type",)) -> DataFrame:
    """The last complete run of each kind, by time and then path."""
    return runs.where("calc_status = 'complete'").groupBy(*by).agg(F.max_by("path", F.struct("creation_time", "path")).alias("path"))


def list_file(spark: SparkSession, path: str) -> DataFrame:
    """Values of a file with one a line; what follows '#' is a remark, blank lines don't count."""
    return spark.read.text(path).select(F.trim(F.split("value", "#")[0]).alias("value")).where("value <> ''")
