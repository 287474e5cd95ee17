"""Parameters of the pipeline."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """Defaults are those of colour images of 32 x 32; ``fixture()`` fits the 8 x 8 fixture."""

    dataset: str = "cifar10"
    samples: int = 50_000
    test_samples: int = 10_000
    optim: str = "two"
    patch_sz: int = 6
    context_sz: int = 32
    grayscale_only: bool = False
    whiten_tol: float = 1e-3
    dict_sz: int = 8192
    gq_thresh: float = 0.3
    dict_thresh: float = 0.7
    zero_code_disable: bool = False
    embed_dim: int = 384
    disable_color_embed_drop: bool = False
    nnclass_k: int = 30
    knn_temp: float = 0.03
    cov_tol: float = 1e-15
    pool_size: int = 4
    pool_stride: int = 2
    seed: int = 7

    @property
    def skip(self) -> int:
        """Leading eigenvectors that are left out."""
        return 1 if self.disable_color_embed_drop else 16

    def __post_init__(self):
        if self.optim not in ("one", "two"):
            raise ValueError("optim is one or two")
        if self.embed_dim + self.skip > self.dict_sz:
            raise ValueError("embed_dim plus the skipped eigenvectors must not exceed dict_sz")
        if min(self.patch_sz, self.dict_sz, self.embed_dim, self.nnclass_k, self.samples, self.test_samples) < 1:
            raise ValueError("sizes must be positive")
        if self.knn_temp <= 0:
            raise ValueError("knn_temp must be positive")

    @classmethod
    def fixture(cls, **more) -> Config:
        return cls(**{"dataset": "fixture", "patch_sz": 3, "context_sz": 8, "dict_sz": 64, "dict_thresh": 0.7, "gq_thresh": 0.6, "embed_dim": 16} | more)
