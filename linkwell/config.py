"""Settings of the record linkage, validated once."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class LinkageConfig:
    """Defaults that results are compared at."""

    bits: int = 2048
    gram_size: int = 2
    threshold: int = 4
    gap_factor: int = 9
    rounds: int = 30
    row_limit: int = 2000
    representatives: int = 3
    name_bytes: int = 128
    chunk_bits: int = 64
    preview_rows: int = 10
    batch_size: int = 2000
    boundary_grams: bool = True
    canonical_bigrams: bool = True
    max_token_edit: int = 1
    min_token_length: int = 4
    min_shared_tokens: int = 2
    noise_rate: float = 0.85
    middle_name_rate: float = 0.2
    seed: int = 42

    def __post_init__(self) -> None:
        if self.bits <= 0:
            raise ValueError("bits must be positive")
        if self.gram_size <= 0:
            raise ValueError("gram_size must be positive")
        if self.representatives <= 0:
            raise ValueError("representatives must be positive")
        if not 0 < self.rounds <= 31:
            raise ValueError("rounds must be from 1 to 31")
        if self.bits % self.chunk_bits:
            raise ValueError("bits must be a multiple of chunk_bits")

    def inclusion(self, n: int) -> float:
        """The chance that a mask holds a bit, for tables of n records at most."""
        return 1.0 - (float(max(n, 1)) * self.gap_factor) ** (-1.0 / (self.threshold * (self.gap_factor - 1.0)))


DEFAULT = LinkageConfig()
