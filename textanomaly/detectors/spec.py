"""Settings of one detector."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace

from textanomaly.operators.losses import norm_family

FAMILIES = ("base", "pruned", "masked", "rsr", "lne")
ACTIVATIONS = ("relu", "sigmoid", "tanh")


@dataclass(frozen=True)
class DetectorSpec:
    """One reconstruction detector.

    Families: ``base`` plain autoencoder; ``pruned`` with a share of all weights
    and biases fixed at zero; ``masked`` with a random mask per weight; ``rsr``
    with a robust subspace layer; ``lne`` with a local-neighbour layer.
    """

    detector_id: str
    family: str = "base"
    input_dim: int | None = None
    contamination: float = 0.1
    hidden_dims: tuple[int, ...] = (128, 64)
    dropout_rate: float = 0.3
    batch_size: int = 32
    batches_per_step: int = 1  # batches whose mean gradient moves the weights once
    batchnorm: bool = True
    standardize: bool = False
    activation: str = "relu"
    learning_rate: float = 1e-3
    epochs: int = 50
    weight_decay: float = 0.0
    loss: str = "mean"  # base, pruned, masked: mean over entries, or a row norm
    prune_ratio: float = 0.0
    connection_prob: float = 0.5
    latent_dim: int | None = None  # width of the subspace or neighbour layer
    normalize: bool = False
    norm_type: str = "MSE"
    loss_norm_type: str = "MSE"
    robust: bool = True
    all_alt: bool = False
    lambda1: float = 0.1
    lambda2: float = 0.1
    lambda3: float = 0.1  # kept for grids; the local term has its own weight
    local_weight: float = 0.1
    n_neighbors: int = 5
    locality: str = "inner"
    score_mode: str = "eval"  # "train" scores with dropout and batch statistics on
    seed: int = 0

    def __post_init__(self):
        object.__setattr__(self, "hidden_dims", tuple(self.hidden_dims))
        object.__setattr__(self, "activation", self.activation.lower())
        if self.family not in FAMILIES:
            raise ValueError(f"unknown family {self.family}")
        if self.activation not in ACTIVATIONS:
            raise ValueError(f"{self.activation} is not a compatible activation function")
        if self.loss != "mean":
            norm_family(self.loss)
        norm_family(self.norm_type)
        norm_family(self.loss_norm_type)
        if self.batch_size < 1 or self.batches_per_step < 1:
            raise ValueError("batch sizes are at least 1")
        if self.locality not in ("inner", "outer") or self.score_mode not in ("eval", "train"):
            raise ValueError("locality is inner or outer, score_mode eval or train")
        if self.family in ("rsr", "lne") and self.latent_dim is None:
            raise ValueError(f"{self.family} needs latent_dim")
        if self.family == "rsr" and self.latent_dim >= self.hidden_dims[-1]:
            raise ValueError("the subspace must be narrower than the last hidden layer")

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> DetectorSpec:
        return cls(**json.loads(text))

    def but(self, **changes) -> DetectorSpec:
        return replace(self, **changes)


def base(detector_id: str = "base", **settings) -> DetectorSpec:
    return DetectorSpec(detector_id, "base", **settings)


def pruned(detector_id: str = "pruned", **settings) -> DetectorSpec:
    return DetectorSpec(detector_id, "pruned", **{"prune_ratio": 0.3, **settings})


def masked(detector_id: str = "masked", **settings) -> DetectorSpec:
    return DetectorSpec(detector_id, "masked", **{"dropout_rate": 0.0, **settings})


def rsr(detector_id: str = "rsr", latent_dim: int = 16, **settings) -> DetectorSpec:
    return DetectorSpec(detector_id, "rsr", latent_dim=latent_dim, **{"hidden_dims": (64, 32), **settings})


def lne(detector_id: str = "lne", latent_dim: int = 16, **settings) -> DetectorSpec:
    return DetectorSpec(detector_id, "lne", latent_dim=latent_dim, **{"robust": False, **settings})
