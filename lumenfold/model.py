"""Settings of a run, their validation and the errors that they raise.

Everything here is checked on the driver before any job starts.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field


class EngineError(Exception):
    """``code`` names the class of the error, ``exit_status`` the status of a command that meets it."""

    code = "internal_error"
    exit_status = 7

    def __init__(self, message: str, **context: object) -> None:
        super().__init__(message)
        self.context = {k: str(v) for k, v in context.items()}

    def envelope(self) -> dict:
        return {"code": self.code, "message": str(self), "context": dict(sorted(self.context.items()))}


class InvalidParameter(EngineError):
    code, exit_status = "invalid_parameter", 2


class InputError(EngineError):
    code, exit_status = "input_error", 3


class UnsupportedInput(EngineError):
    code, exit_status = "unsupported_input", 4


class ResourceLimit(EngineError):
    code, exit_status = "resource_limit_exceeded", 5


class OutputError(EngineError):
    code, exit_status = "output_error", 6


# fixed values
DPIS = (300, 400, 600)
METHODS = ("otsu", "sauvola", "manual")
DESPECKLE = {"off": 0, "conservative": 4, "strong": 12}
MAX_PAGES, MAX_EDGE, MAX_PIXELS, MAX_ROIS, MAX_RUNS = 10_000, 20_000, 200_000_000, 64, 256
MAX_RENDERED_PIXELS = 400_000_000


def single(x: float) -> float:
    """The double that holds ``x`` rounded to single precision."""
    return struct.unpack("<f", struct.pack("<f", x))[0]


def float_bits(x: float) -> int:
    return struct.unpack("<I", struct.pack("<f", x))[0]


@dataclass(frozen=True)
class Run:
    """One processing run: resolution, method and clean-up."""

    run_id: str
    dpi: int = 300
    method: str = "otsu"
    threshold: int | None = None
    window_size: int = 33
    k: float = 0.2
    dynamic_range: float = 128.0
    contrast: float = 0.0
    median_denoise: bool = False
    background_normalization: bool = False
    background_radius: int = 31
    despeckle: str = "off"
    max_component_pixels: int | None = None
    tags: tuple[str, ...] = field(default=())

    def validate(self) -> Run:
        if self.dpi not in DPIS:
            raise InvalidParameter(f"dpi must be one of {DPIS}", dpi=self.dpi)
        if self.method not in METHODS:
            raise InvalidParameter(f"method must be one of {METHODS}", method=self.method)
        if self.method == "manual" and (self.threshold is None or not 0 <= self.threshold <= 255):
            raise InvalidParameter("manual needs a threshold from 0 to 255", threshold=self.threshold)
        if self.method != "manual" and self.threshold is not None:
            raise InvalidParameter("a threshold is for manual only", method=self.method)
        if self.method == "sauvola" and (self.window_size < 3 or self.window_size % 2 == 0 or not self.k > 0 or not self.dynamic_range > 0):
            raise InvalidParameter("sauvola needs an odd window of 3 or more, and positive k and range", window=self.window_size)
        if not -1 <= self.contrast <= 1:
            raise InvalidParameter("contrast must lie in [-1, 1]", contrast=self.contrast)
        if self.background_normalization and self.background_radius < 1:
            raise InvalidParameter("background radius must be positive", radius=self.background_radius)
        if self.despeckle not in DESPECKLE:
            raise InvalidParameter(f"despeckle must be one of {tuple(DESPECKLE)}", despeckle=self.despeckle)
        return self

    @property
    def speckle_pixels(self) -> int:
        if self.despeckle == "off":
            return 0
        return DESPECKLE[self.despeckle] if self.max_component_pixels is None else self.max_component_pixels

    def fingerprint(self) -> str:
        """Equal for settings that give equal output; single-precision values by their bits."""
        method = {"otsu": "otsu", "manual": f"manual:{self.threshold}", "sauvola": f"sauvola:{self.window_size}:{float_bits(self.k)}:{float_bits(self.dynamic_range)}"}[self.method]
        parts = {
            "dpi": self.dpi,
            "method": method,
            "contrast": float_bits(self.contrast),
            "denoise": str(self.median_denoise).lower(),
            "bgnorm": f"{str(self.background_normalization).lower()}:{self.background_radius}",
            "despeckle": f"{self.despeckle.capitalize()}:{'None' if self.max_component_pixels is None else f'Some({self.max_component_pixels})'}",
        }
        return ";".join(f"{k}={v}" for k, v in parts.items())


def sauvola_window_for_dpi(dpi: int) -> int:
    """Nearest odd window to 0.08 of the resolution, from 15 to 75."""
    n = int(min(max(dpi * 0.08 + 0.5, 15), 75))
    return n if n % 2 else n + 1


BASELINE_RUNS = (Run("otsu-300"), Run("sauvola-300-default", method="sauvola"), Run("manual-300-128", method="manual", threshold=128))
PRESETS = {
    "default": Run("default", 400, "sauvola", window_size=sauvola_window_for_dpi(400)),
    "fine-detail": Run("fine-detail", 600, "sauvola", window_size=15, k=0.2),
    "noisy-scan": Run("noisy-scan", 400, "sauvola", window_size=sauvola_window_for_dpi(400), k=0.3, median_denoise=True, background_normalization=True, despeckle="conservative"),
}
