"""Dataset specifications and job parameters.

Chosen on the driver when a plan is built; an unknown name raises ``ValueError`` before any
job runs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class DatasetSpec:
    name: str
    source_name: str | None
    version: str | None
    has_valid: bool
    split_map: dict[str, str]          # logical split -> source split
    batch_size: int
    train_batch_idxs: tuple[int, ...]
    test_batch_idxs: tuple[int, ...]
    valid_batch_idxs: tuple[int, ...] | None = None
    family: str = ""                   # parser family (cqa, svamp, asdiv, esnli, anli)
    models: tuple[str, ...] = ("palm", "gpt")

    @property
    def train_cap(self) -> int:
        return len(self.train_batch_idxs) * self.batch_size


# --- fixed values: per-dataset constants ---------------------------------------------------
# cqa:   source cos_e v1.11, no valid split, train->train test->validation, batch 1000,
#        train batches 0..9, test batches 0..1
# svamp: source svamp, no valid, train/test, batch 500, train 0..1, test 0
# asdiv: no valid, train/test, batch 1000, train 0..2, test 0, first model only
# esnli: source esnli, valid, train/valid->validation/test, batch 5500, train 0..99 (full)
#        or 0..9 (small), test 0..1, valid 0..1
# anli1: source anli, valid, train->train_r1 valid->dev_r1 test->test_r1, batch 5000,
#        train 0..3, test 0, valid 0
def _specs() -> dict[str, DatasetSpec]:
    return {
        "cqa": DatasetSpec("cqa", "cos_e", "v1.11", False, {"train": "train", "test": "validation"},
                           1000, tuple(range(10)), tuple(range(2)), None, "cqa"),
        "svamp": DatasetSpec("svamp", "svamp", None, False, {"train": "train", "test": "test"},
                             500, tuple(range(2)), tuple(range(1)), None, "svamp"),
        "asdiv": DatasetSpec("asdiv", None, None, False, {"train": "train", "test": "test"},
                             1000, tuple(range(3)), tuple(range(1)), None, "asdiv", ("palm",)),
        "esnli": DatasetSpec("esnli", "esnli", None, True,
                             {"train": "train", "valid": "validation", "test": "test"},
                             5500, tuple(range(100)), tuple(range(2)), tuple(range(2)), "esnli"),
        "esnli_small": DatasetSpec("esnli", "esnli", None, True,
                                   {"train": "train", "valid": "validation", "test": "test"},
                                   5500, tuple(range(10)), tuple(range(2)), tuple(range(2)), "esnli"),
        "anli1": DatasetSpec("anli1", "anli", None, True,
                             {"train": "train_r1", "valid": "dev_r1", "test": "test_r1"},
                             5000, tuple(range(4)), tuple(range(1)), tuple(range(1)), "anli"),
    }
# ---------------------------------------------------------------------------------------------


SPECS = _specs()


def spec_for(dataset: str, subset: str = "full") -> DatasetSpec:
    if dataset == "esnli" and subset not in ("full", "small"):
        raise ValueError(f"unknown E-NLI subset {subset!r}")
    key = "esnli_small" if (dataset == "esnli" and subset == "small") else dataset
    if key not in SPECS:
        raise ValueError(f"unknown dataset {dataset!r}")
    return SPECS[key]


@dataclass(frozen=True)
class JobConfig:
    """Run parameters, by the stage that reads them."""
    # loading and labels
    dataset: str
    llm: str | None = "palm"
    label_type: str = "gt"
    subsample: float = 1.0
    run: int = 0                # also the subsample's seed
    # encoding
    model_type: str = "task_prefix"
    from_pretrained: str = "google/t5-v1_1-base"
    max_input_length: int = 1024
    # batches and losses
    batch_size: int = 64
    grad_steps: int = 1
    alpha: float = 0.5
    output_rationale: bool = False
    # only part of the run folder's name
    optimizer_name: str = "AdamW"
    lr: float = 5e-5

    def validate(self) -> None:
        spec_for(self.dataset if self.dataset != "asdiv" else "svamp")
        if self.llm not in (None, "palm", "gpt"):
            raise ValueError(f"unknown model {self.llm!r}")
        if self.label_type not in ("gt", "llm") or (self.label_type == "llm" and self.llm is None):
            raise ValueError("label_type must be 'gt', or 'llm' with a model")
        if self.model_type not in ("task_prefix", "standard"):
            raise ValueError(f"unknown model_type {self.model_type!r}")
        if self.model_type == "task_prefix" and self.llm is None:
            raise ValueError("task_prefix needs model rationales")


def _py(v) -> str:
    """How an f-string prints a parameter (``5e-05``, ``1.0``, ``None``)."""
    return str(v)


def run_path_columns(cfg: JobConfig, overrides: dict[str, Column] | None = None) -> dict[str, Column]:
    """Columns for the 11-part run folder; ``overrides`` take per-row values from a table.

    Float parameters stay as configured text: a DOUBLE cast would print ``5.0E-5``.
    """
    o = overrides or {}

    def val(name: str) -> Column:
        return o[name].cast("string") if name in o else F.lit(_py(getattr(cfg, name)))

    model = F.get(F.split(o.get("from_pretrained", F.lit(cfg.from_pretrained)), "/", -1), 1)
    model = F.coalesce(model, F.raise_error(F.lit("from_pretrained has no '/'")).cast("string"))
    bsz = (o.get("grad_steps", F.lit(cfg.grad_steps)) * o.get("batch_size", F.lit(cfg.batch_size))).cast("string")
    parts = [val("dataset"), model, val("model_type"), val("llm"), val("subsample"), val("label_type"),
             val("alpha"), val("max_input_length"), bsz, val("optimizer_name"), val("lr")]
    config_dir = F.concat_ws("/", *parts)   # no part can be NULL: NULL model raises above
    run = val("run")
    return {"config_dir": config_dir,
            "output_dir": F.concat(F.lit("ckpts/"), config_dir, F.lit("/"), run),
            "logging_dir": F.concat(F.lit("logs/"), config_dir, F.lit("/"), run)}
