"""Configuration: frozen defaults, nested overrides and dotted access, all on the driver."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, is_dataclass, replace
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class Assessment:
    blur_threshold: float = 100.0
    noise_threshold: float = 0.02
    contrast_threshold: float = 50.0
    skew_threshold: float = 2.0
    min_dpi: int = 150
    render_dpi: int = 300


@dataclass(frozen=True)
class Enhancement:
    auto_deskew: bool = True
    auto_denoise: bool = True
    auto_sharpen: bool = True
    clahe_clip_limit: float = 2.0
    clahe_tiles: tuple[int, int] = (8, 8)


@dataclass(frozen=True)
class Layout:
    header_ratio: float = 0.12
    footer_ratio: float = 0.10
    min_region_area: int = 2000
    min_region_dim: int = 20
    table_min_lines: int = 2
    h_line_span: float = 0.10
    v_line_span: float = 0.03
    merged_column: int | None = None


@dataclass(frozen=True)
class Extraction:
    region_padding: int = 4


@dataclass(frozen=True)
class Ocr:
    engine: str = "paddleocr"
    fallback_engine: str = "tesseract"
    lang: str = "en"
    doubt_threshold: float = 0.80


@dataclass(frozen=True)
class Config:
    assessment: Assessment = field(default_factory=Assessment)
    enhancement: Enhancement = field(default_factory=Enhancement)
    layout: Layout = field(default_factory=Layout)
    extraction: Extraction = field(default_factory=Extraction)
    ocr: Ocr = field(default_factory=Ocr)

    def get(self, dotted: str, default: Any = None) -> Any:
        """Value at a dotted path, the default as soon as a part is missing."""
        node: Any = asdict(self)
        for part in dotted.split("."):
            if not isinstance(node, dict) or part not in node:
                return default
            node = node[part]
        return node

    def section(self, name: str) -> dict:
        node = self.get(name)
        return node if isinstance(node, dict) else {}


def override(config: Any, values: dict) -> Any:
    """The configuration with nested values replaced; unknown keys are an error."""
    known = {f.name for f in fields(config)}
    if unknown := set(values) - known:
        raise KeyError(f"unknown settings: {', '.join(sorted(unknown))}")
    new = {k: override(getattr(config, k), v) if is_dataclass(getattr(config, k)) else tuple(v) if isinstance(v, list) else v for k, v in values.items()}
    return replace(config, **new)


def load(path: str | None = None) -> Config:
    """Defaults with the file's values over them (JSON, or YAML where a YAML parser is installed)."""
    if path is None:
        return Config()
    text = Path(path).read_text()
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("no YAML parser is installed; use JSON") from e
        return override(Config(), yaml.safe_load(text) or {})
    return override(Config(), json.loads(text))
