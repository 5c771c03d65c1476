"""Block decomposition of a dimension: pure functions for extents, layouts and neighbours."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field


class DomainMismatchError(ValueError):
    """A field does not fit the domain it is said to lie on."""


class HaloWidthError(ValueError):
    """A halo is negative or wider than the dimension."""


def compute_extent(length: int, rank: int, size: int, min_chunk: int | None = None) -> tuple[int, int]:
    """[start, stop) of block `rank` of `size` near-equal blocks; earlier blocks take the remainder.

    With min_chunk, at most length // min_chunk blocks (at least one) get rows; the others are empty.
    """
    if length < 0 or size < 1 or not 0 <= rank < size:
        raise ValueError("length must not be negative and rank must lie in [0, size)")
    used = size if not min_chunk else max(1, min(size, length // min_chunk))
    if rank >= used:
        return length, length
    base, more = divmod(length, used)
    start = rank * base + min(rank, more)
    return start, start + base + (rank < more)


def compute_domains(length: int, size: int, min_chunk: int | None = None) -> list[tuple[int, int]]:
    return [compute_extent(length, r, size, min_chunk) for r in range(size)]


def shapes(blocks: int, dims: int) -> Iterator[tuple[int, ...]]:
    """Every way to write a number of blocks as an ordered product over the dimensions."""
    if dims == 1:
        yield (blocks,)
        return
    for first in range(1, blocks + 1):
        if blocks % first == 0:
            for rest in shapes(blocks // first, dims - 1):
                yield (first, *rest)


def copied_rows(extents: Sequence[int], shape: Sequence[int]) -> int:
    """Cells copied between neighbours by a halo of one, summed over all inner edges of the blocks that hold cells."""
    cells, total = math.prod(extents), 0
    for length, parts in zip(extents, shape, strict=True):
        used = sum(b > a for a, b in compute_domains(length, parts))
        if length and used > 1:
            total += 2 * (used - 1) * (cells // length)
    return total


def define_layout(extents: Sequence[int], blocks: int) -> tuple[int, ...]:
    """Grid shape over any number of dimensions: fewest blocks without cells, then fewest cells in halos, then the least loaded largest block."""
    if blocks < 1 or not extents:
        raise ValueError("a layout has at least one dimension and one block")

    def rank(shape: tuple[int, ...]) -> tuple:
        parts = [[b - a for a, b in compute_domains(n, p)] for n, p in zip(extents, shape, strict=True)]
        full = math.prod(sum(x > 0 for x in own) for own in parts)
        return blocks - full, copied_rows(extents, shape), math.prod(max(own) for own in parts), shape

    return min(shapes(blocks, len(extents)), key=rank)


def aligned_domains(length: int, size: int, chunks: Iterable[int] = ()) -> list[tuple[int, int]]:
    """Blocks whose bounds are multiples of all given chunk lengths, if there are at least as many such multiples as blocks; else near-equal ones."""
    step = math.lcm(*(c for c in chunks if c > 0)) if chunks else 1
    if step <= 1 or length < step * size:
        return compute_domains(length, size)
    return [(a * step, min(b * step, length)) for a, b in compute_domains(-(-length // step), size)]


def save_chunks(shape: Sequence[int], bounds: Sequence[Sequence[tuple[int, int]]], itemsize: int, most: int = 1 << 31) -> tuple[int, ...]:
    """Chunk lengths that cut no block in two: of each dimension the greatest common divisor of its inner bounds, halved until a chunk has at most `most` bytes."""
    out = [max(1, math.gcd(*(a for a, b in own if a and b > a)) or n) for n, own in zip(shape, bounds, strict=True)]
    while math.prod(out) * itemsize > most and max(out) > 1:
        i = out.index(max(out))
        out[i] = max(d for d in range(1, out[i] // 2 + 1) if out[i] % d == 0)
    return tuple(out)


@dataclass(frozen=True)
class Domain:
    """Blocks of one or more dimensions, with halos."""

    dims: tuple[str, ...]
    sizes: tuple[int, ...]
    shape: tuple[int, ...]
    halo: dict[str, tuple[int, int]] = field(default_factory=dict)
    cyclic: frozenset[str] = frozenset()
    min_chunk: int | None = None

    def __post_init__(self):
        if not len(self.dims) == len(self.sizes) == len(self.shape):
            raise DomainMismatchError("dims, sizes and shape must have equal lengths")

    @property
    def blocks(self) -> int:
        return math.prod(self.shape)

    def axis(self, dim: str) -> int:
        if dim not in self.dims:
            raise DomainMismatchError(f"{dim!r} is not a dimension of the domain")
        return self.dims.index(dim)

    def coordinates(self, block: int) -> tuple[int, ...]:
        out = []
        for n in reversed(self.shape):
            block, r = divmod(block, n)
            out.append(r)
        return tuple(reversed(out))

    def compute_domain(self, dim: str, block: int) -> tuple[int, int]:
        i = self.axis(dim)
        return compute_extent(self.sizes[i], self.coordinates(block)[i], self.shape[i], self.min_chunk)

    def data_domain(self, dim: str, block: int) -> tuple[int, int]:
        """The compute domain with its halo; clipped unless the dimension is cyclic."""
        a, b = self.compute_domain(dim, block)
        before, after = self.halo.get(dim, (0, 0))
        if dim in self.cyclic:
            return a - before, b + after
        return max(0, a - before), min(self.sizes[self.axis(dim)], b + after)

    def global_domain(self, dim: str) -> tuple[int, int]:
        return 0, self.sizes[self.axis(dim)]

    def extents(self, dim: str) -> list[int]:
        i = self.axis(dim)
        return [b - a for a, b in compute_domains(self.sizes[i], self.shape[i], self.min_chunk)]

    def components(self) -> dict[str, list[tuple[int, int]]]:
        return {d: compute_domains(self.sizes[i], self.shape[i], self.min_chunk) for i, d in enumerate(self.dims)}

    def neighbours(self, dim: str, block: int) -> tuple[int | None, int | None]:
        """Block ids before and after along dim; None at an edge that isn't cyclic."""
        i, at = self.axis(dim), list(self.coordinates(block))
        out: list[int | None] = []
        for step in (-1, 1):
            to = at[i] + step
            if not 0 <= to < self.shape[i]:
                if dim not in self.cyclic:
                    out.append(None)
                    continue
                to %= self.shape[i]
            spot = at[:i] + [to] + at[i + 1 :]
            out.append(sum(c * math.prod(self.shape[j + 1 :]) for j, c in enumerate(spot)))
        return out[0], out[1]
