"""Settings of the three commands, and a reader for their flat YAML files."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields
from typing import Any


@dataclass(frozen=True)
class MinHashConfig:
    """``mode`` is ``fuzzy`` or ``exact``; the latter groups documents by their whole raw text. ``vocabulary`` is the folder of byte-pair vocabularies."""

    num_bands: int = 14
    band_size: int = 8
    ngram_size: int = 5
    tokenizer: str = "uniseg"
    vocabulary: str | None = None
    mode: str = "fuzzy"
    hash_seed: int = 0
    content_key: str = "text"
    concat_key: tuple[str, ...] | None = None
    annotate_only: bool = False
    portable: bool = True


@dataclass(frozen=True)
class ExactConfig:
    text_field: str = "text"
    annotate_only: bool = False


@dataclass(frozen=True)
class SubsampleConfig:
    cc_field: str = "exact_dedup"
    subsample_rate: float = 1.0
    max_cc_size: int | None = None
    seed: int = 0


def _scalar(x: str) -> Any:
    x = x.strip()
    if x[:1] in "'\"" and len(x) > 1 and x[-1] == x[0]:
        return x[1:-1]
    if x in ("", "null", "~"):
        return None
    if x in ("true", "false"):
        return x == "true"
    if re.fullmatch(r"[-+]?\d+", x):
        return int(x)
    if re.fullmatch(r"[-+]?(\d+\.\d*|\.\d+)([eE][-+]?\d+)?", x):
        return float(x)
    if x[0] == "[" and x[-1] == "]":
        return [_scalar(y) for y in x[1:-1].split(",") if y.strip()]
    return x


def parse_flat_yaml(source: str) -> dict[str, Any]:
    """Keys with scalars or lists of scalars; anything deeper is an error."""
    out: dict[str, Any] = {}
    last = None
    for number, line in enumerate(source.splitlines(), 1):
        bare = re.sub(r"(^|\s)#.*$", "", line).rstrip()
        if not bare.strip() or bare.strip() == "---":
            continue
        if (m := re.fullmatch(r"\s*-\s+(.*)", bare)) and last:
            if not isinstance(out[last], list):
                out[last] = []
            out[last].append(_scalar(m[1]))
        elif m := re.fullmatch(r"([A-Za-z_]\w*):(?:\s+(.*))?", bare):
            last = m[1]
            out[last] = _scalar(m[2] or "")
        else:
            raise ValueError(f"line {number} isn't a flat setting")
    return out


def _pick(kind: type, given: dict[str, Any]) -> Any:
    names = {f.name for f in fields(kind)}
    return kind(**{k: v for k, v in given.items() if k in names and v is not None})


def minhash_config(given: dict[str, Any]) -> MinHashConfig:
    """From a settings file: ``exact_override: true`` there means fuzzy matching, and false, the default, whole-text matching."""
    given = dict(given)
    given["tokenizer"] = given.get("tokenizer_str", "uniseg")
    given["mode"] = given.get("mode") or ("fuzzy" if given.get("exact_override") else "exact")
    if given.get("concat_key") is not None:
        keys = given["concat_key"]
        given["concat_key"] = tuple(keys) if isinstance(keys, list) else (keys,)
    return _pick(MinHashConfig, given)


def exact_config(given: dict[str, Any]) -> ExactConfig:
    return _pick(ExactConfig, given)


def subsample_config(given: dict[str, Any]) -> SubsampleConfig:
    return _pick(SubsampleConfig, given)
