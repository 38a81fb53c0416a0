"""Settings and fixed values of the fraud-scoring domain."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

# Fixed values that results depend on.
DIMS = 14
SCALE = 10_000
BLOCK_ROWS = 64
PARTITIONS = 256
#: Dimension that decides bit b of the partition key, and the value it must exceed.
PARTITION_DIMS = (0, 2, 7, 12, 8, 1, 3, 4)
PARTITION_ABOVE = 5_000
#: Order of rows within a partition.
SORT_DIMS = (8, 1, 3, 4)
K = 5
POOL = 10
DENY_VOTES = 3
NLIST, NPROBE, ITERATIONS, COARSE_GROUP = 16_384, 3, 5, 256
READY_ROWS = 5
EVALUATION_QUERIES, EVALUATION_FIRST = 1_000, 7
FORMAT_VERSION = 1
DEFAULT_RISK = 0.5
MCC_RISK = {"5411": 0.15, "5812": 0.30, "5912": 0.20, "5944": 0.45, "7801": 0.80, "7802": 0.75, "7995": 0.85, "4511": 0.35, "5311": 0.25, "5999": 0.50}


@dataclass(frozen=True)
class Normalization:
    max_amount: float = 10_000.0
    max_installments: float = 12.0
    amount_vs_avg_ratio: float = 10.0
    max_minutes: float = 1_440.0
    max_km: float = 1_000.0
    max_tx_count_24h: float = 20.0
    max_merchant_avg_amount: float = 10_000.0


@dataclass(frozen=True)
class Config:
    normalization: Normalization = Normalization()
    mcc_risk: dict[str, float] = field(default_factory=lambda: dict(MCC_RISK))
    dataset_dir: str = "data/index"


def load_config(normalization_path: str | None = None, mcc_risk_path: str | None = None) -> Config:
    """Config from JSON files; paths default to the environment's, values to the fixed ones."""
    env = os.environ.get
    normalization_path = normalization_path or env("NORMALIZATION_PATH")
    mcc_risk_path = mcc_risk_path or env("MCC_RISK_PATH")

    def read(path: str) -> dict:
        with open(path, encoding="utf-8") as f:
            return json.load(f)

    return Config(
        Normalization(**{k: float(v) for k, v in read(normalization_path).items()}) if normalization_path else Normalization(),
        {str(k): float(v) for k, v in read(mcc_risk_path).items()} if mcc_risk_path else dict(MCC_RISK),
        env("DATASET_DIR", "data/index"),
    )
