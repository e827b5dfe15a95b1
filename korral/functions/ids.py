"""Stable identifiers and packed seeds as column expressions."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of epoch, model, dataset, problem and sample in a packed 48-bit seed.
SEED_BITS = {"epoch": 6, "model_idx": 6, "dataset_idx": 6, "problem_idx": 10, "sample_idx": 20}


def digest(*parts: Column, n: int = 12) -> Column:
    """The first n hex digits of the SHA-256 of the parts, joined by the unit separator; a null part is an error."""
    text = [F.coalesce(p.cast("string"), F.raise_error(F.lit("null in an identifier"))) for p in parts]
    return F.substring(F.sha2(F.concat_ws("\x1f", *text), 256), 1, n)


def sample_uid(exp_id: Column, model: Column, dataset: Column, variant: Column, sampling_id: Column, problem_idx: Column, sample_idx: Column) -> Column:
    return digest(exp_id, model, dataset, variant, sampling_id, problem_idx, sample_idx, n=16)


def unit_id(exp_id: Column, model: Column, dataset: Column, variant: Column, sampling_id: Column, pshard: Column, lo: Column, hi: Column) -> Column:
    return digest(exp_id, model, dataset, variant, sampling_id, pshard, lo, hi)


def content_sha(text: Column) -> Column:
    """16 hex digits of a text's SHA-256: problem ids (of the normalised question) and prompt ids."""
    return F.substring(F.sha2(text, 256), 1, 16)


def seed(**parts: Column) -> Column:
    """Pack a seed; a part outside its bits is an error. The packing is injective."""
    out = F.lit(0).cast("bigint")
    for name, bits in SEED_BITS.items():
        c = parts[name].cast("bigint")
        ok = F.when(c.between(0, (1 << bits) - 1), c).otherwise(F.raise_error(F.concat(F.lit(f"{name} out of range: "), F.coalesce(c.cast("string"), F.lit("null")))).cast("bigint"))
        out = F.shiftleft(out, bits).bitwiseOR(ok)
    return out


def unpack(packed: Column) -> Column:
    """The parts of a packed seed as a struct."""
    fields, shift = [], sum(SEED_BITS.values())
    for name, bits in SEED_BITS.items():
        shift -= bits
        fields.append(F.shiftrightunsigned(packed, shift).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint")).alias(name))
    return F.struct(*fields)


def sampling_id(spec: dict) -> str:
    """8 hex digits of a sampling spec: everything but the chunk size, which doesn't change what is sampled."""
    blob = json.dumps({k: v for k, v in spec.items() if k != "chunk_size"}, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(blob.encode()).hexdigest()[:8]


def grading_id(graders: tuple[str, ...], policies: tuple[str, ...]) -> str:
    """8 hex digits of a grading configuration, whatever order its graders and policies are named in."""
    blob = json.dumps({"graders": sorted(graders), "policies": sorted(policies)}, sort_keys=True)
    return hashlib.sha256(blob.encode()).hexdigest()[:8]


def engine_fingerprint(backend: str, prefix_caching: bool = True) -> str:
    """What generated a shard: the backend's version, then the settings that don't count as another engine."""
    return f"{backend}|pfxcache={int(prefix_caching)}"


def index_hash(rows: list[tuple[str, int]]) -> str:
    """SHA-256 of the sorted key=index lines of a registry: what a freeze commits to."""
    return hashlib.sha256("\n".join(sorted(f"{k}={i}" for k, i in rows)).encode()).hexdigest()
