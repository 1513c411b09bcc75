"""Schemas and settings shared by the operators. A missing pointer or answer is NULL, never a sentinel."""

from __future__ import annotations

from dataclasses import dataclass

BLOCKS = "seq_id long, level int, blk long, start long, block_size long, is_internal boolean, ptr_blk long, ptr_off long, internal_rank long, back_rank long, ptr_child_base long, ptr_next_child_base long"
LEAVES = "seq_id long, leaf_blk long, content string"


@dataclass(frozen=True)
class TreeConfig:
    """arity: children of a block. roots: blocks of the top level at least, 0: one for each Lempel-Ziv phrase.
    max_leaf: longest leaf. cut: drop leading levels without a back reference. prune: replace
    blocks that an earlier copy makes unnecessary. sources: how repeats are found, ``windows`` (content
    keys) or ``lpf`` (longest previous factors)."""

    arity: int = 4
    roots: int = 4
    max_leaf: int = 8
    cut: bool = True
    prune: bool = True
    sources: str = "windows"

    def __post_init__(self) -> None:
        if self.arity < 2 or self.roots < 0 or self.max_leaf < 1 or self.sources not in ("windows", "lpf"):
            raise ValueError(f"not a tree configuration: {self}")
