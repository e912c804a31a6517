"""All thresholds in one frozen object, from defaults or a YAML file."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from functools import lru_cache
from pathlib import Path
from typing import Any

# The corpus' published settings.
PERICOPE = ["B04K7V53", *[f"B04K8V{v}" for v in range(1, 12)]]


@dataclass(frozen=True)
class Settings:
    seed: int = 20260624
    book: str = "B04"
    title: str = "John"
    polarity: str = "positive"
    base_witness: str = "basetext"
    main_type: str = "main"
    lacuna_type: str = "lac"
    folded_type: str = "subreading"
    omission_types: tuple[str, ...] = ("om", "om_verse")
    pericope: tuple[str, ...] = tuple(PERICOPE)
    interpolations: tuple[str, ...] = ("B04K5V4",)
    alpha: float = 0.05
    n_permutations: int = 10_000
    gate_permutations: int = 2_000
    genealogy_bootstrap: int = 100
    robustness_bootstrap: int = 500
    stylometry_permutations: int = 5_000
    min_units: int = 200
    min_extant: int = 30
    max_modal: float = 0.90
    min_overlap: int = 100
    n_clusters: int = 12
    clade_compactness: float = 0.12
    monophyly_purity: float = 0.70
    validation_k_max: int = 30
    n_mfw: int = 100
    window: int = 200
    separation_ratio: float = 1.3
    anchor_at: float = 0.99
    low_confidence_max_early: int = 5
    low_confidence_min_families: int = 4
    low_confidence_min_eff_families: float = 1.6
    early_until: int = 500
    extra: dict[str, Any] = field(default_factory=dict, hash=False, compare=False)


#: Where a setting stands in the YAML file: section and key.
_PLACES = {
    "seed": (None, "seed"),
    "book": ("corpus", "book"),
    "polarity": ("corpus", "density_polarity"),
    "pericope": ("validation", "pericope_adulterae"),
    "interpolations": ("validation", "known_interpolations"),
    "alpha": ("stats", "fdr_alpha"),
    "n_permutations": ("stats", "n_permutations"),
    "gate_permutations": ("stats", "gate_export_permutations"),
    "genealogy_bootstrap": ("stats", "genealogy_bootstrap"),
    "robustness_bootstrap": ("stats", "robustness_bootstrap"),
    "stylometry_permutations": ("stats", "stylometry_permutations"),
    "early_until": ("dashboard", "early_witness_max_date"),
} | {
    f.name: (section, f.name)
    for f in fields(Settings)
    for section in [
        "genealogy"
        if f.name in {"min_units", "min_extant", "max_modal", "min_overlap", "n_clusters", "clade_compactness", "monophyly_purity", "validation_k_max"}
        else "stylometry"
        if f.name in {"n_mfw", "window", "separation_ratio"}
        else "dashboard"
        if f.name.startswith("low_confidence")
        else ""
    ]
    if section
}


def find_root(start: Path, marker: str = "config.yaml") -> Path | None:
    """The nearest folder from ``start`` upwards that holds ``marker``."""
    for folder in (start, *start.parents):
        if (folder / marker).is_file():
            return folder
    return None


@lru_cache(maxsize=16)
def load(path: str | None = None) -> Settings:
    """Settings of a YAML file; without a path those of the nearest config.yaml, or else the defaults."""
    if path is None:
        root = find_root(Path.cwd())
        if root is None:
            return Settings()
        path = str(root / "config.yaml")
    import yaml

    raw = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    given: dict[str, Any] = {}
    for name, (section, key) in _PLACES.items():
        block = raw if section is None else raw.get(section) or {}
        if key in block:
            value = block[key]
            given[name] = tuple(value) if isinstance(value, list) else value
    return Settings(**given, extra=raw)
