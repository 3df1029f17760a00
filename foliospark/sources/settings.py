"""Settings, from the environment or any other mapping."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from foliospark.operators.routing import KEY_NAMES, PROVIDERS, EngineConfig
from foliospark.plans.refine import RefineOptions

_MODEL = re.compile(r"[A-Za-z0-9_.:\-/]{1,100}")
# The two languages' defaults of a request
DEFAULT_LOCALE, DEFAULT_TYPE = "de-DE", "exact"


@dataclass(frozen=True)
class ModelSetup:
    """status: off, error or ready."""

    status: str
    provider: str = ""
    model: str = ""
    reason: str = ""

    @classmethod
    def of(cls, settings: dict[str, str], default_models: dict[str, str] | None = None) -> ModelSetup:
        """From LLM_PROVIDER, LLM_MODEL and the provider's key; a provider without a default model needs one to be named."""
        provider = (settings.get("LLM_PROVIDER") or "").strip().lower()
        if provider in ("", "none"):
            return cls("off")
        if provider not in PROVIDERS:
            return cls("error", reason=f"LLM_PROVIDER {provider!r} is none of {', '.join(PROVIDERS)}")
        if not settings.get(KEY_NAMES[provider]):
            return cls("error", reason=f"{KEY_NAMES[provider]} is not set")
        model = (settings.get("LLM_MODEL") or "").strip() or (default_models or {}).get(provider, "")
        if not model:
            return cls("error", reason="LLM_MODEL is not set")
        if not _MODEL.fullmatch(model):
            return cls("error", reason=f"LLM_MODEL {model!r} is no model name")
        return cls("ready", provider, model)


@dataclass(frozen=True)
class Settings:
    max_upload_mb: float = 100
    max_pages: int = 50
    image_pixels: int = 2576
    concurrency: int = 3
    timeout_s: float = 180
    transcribe: bool = True
    own_names: tuple[str, ...] = ()
    engine: EngineConfig = field(default_factory=EngineConfig)
    refine: RefineOptions = field(default_factory=RefineOptions)
    model: ModelSetup = field(default_factory=lambda: ModelSetup("off"))

    @classmethod
    def of(cls, settings: dict[str, str]) -> Settings:
        def number(name: str, default: float) -> float:
            return float(settings.get(name) or default)

        return cls(
            number("MAX_UPLOAD_MB", 100), int(number("LLM_MAX_PAGES", 50)), int(number("LLM_IMAGE_MAX_PX", 2576)), max(1, int(number("LLM_CONCURRENCY", 3))),
            number("LLM_TIMEOUT_S", 180), (settings.get("LLM_TRANSCRIBE") or "true").strip().lower() != "false",
            tuple(n for n in (p.strip() for p in (settings.get("OWN_NAMES") or "").split(";")) if n),
            EngineConfig.of(settings), RefineOptions.of(settings), ModelSetup.of(settings),
        )


def read_env_file(text: str) -> dict[str, str]:
    """NAME=value lines; comments and quotes around values are dropped."""
    pairs = (line.split("=", 1) for line in text.splitlines() if "=" in line and not line.lstrip().startswith("#"))
    return {name.strip(): value.strip().strip("\"'") for name, value in pairs}


def languages_from_listing(listing: str) -> list[str]:
    """Installed languages from the recogniser's list, whose first line is a header."""
    return [line.strip() for line in listing.splitlines()[1:] if line.strip()]


def version_from_listing(listing: str) -> str:
    return (listing.splitlines() or [""])[0].strip()
