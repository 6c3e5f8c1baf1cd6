"""Knobs of the linkage operators, in one frozen value; operators read no environment."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    name_df_cap: int = 2_000
    addr_df_cap: int = 10_000
    name_top_k: int = 40
    addr_top_k: int = 60
    canonical_cap: int = 5
    key_cap: int = 50
    rarest: int = 3
    df_floor: int = 2
    max_digit_tokens: int = 2
    candidate_cap: int = 150
    recall: float = 1.0
    bar_scale: float = 1.0


#: For small fixtures, on which the default caps never bite.
SMALL = Config(name_df_cap=50, addr_df_cap=50, name_top_k=10, addr_top_k=10, candidate_cap=20)
