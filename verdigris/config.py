"""Typed settings; YAML files in the usual two-file layout can be loaded into them."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields, is_dataclass, replace
from pathlib import Path

SCHEMES = ("simple_1",)
#: Window presets of the sensitivity study: (size, stride).
WINDOW_PRESETS = {"default": (50, 10), "fine": (40, 5), "coarse": (60, 15)}


@dataclass(frozen=True)
class Watermark:
    """Green-list parameters: share, logit bias, key, seeding scheme, which end of the permutation is green."""

    gamma: float = 0.25
    delta: float = 1.5
    hash_key: int = 15485863
    scheme: str = "simple_1"
    select_green_tokens: bool = True
    z_threshold: float = 4.0

    def __post_init__(self):
        if self.scheme not in SCHEMES:
            raise NotImplementedError(f"seeding scheme {self.scheme!r}")
        if not 0 < self.gamma < 1:
            raise ValueError("gamma must lie between 0 and 1")


@dataclass(frozen=True)
class Corpus:
    """How samples are cut: lines skipped, words per sample, samples wanted (None: all)."""

    skip_lines: int = 200
    words_per_sample: int = 4000
    num_samples: int | None = 1000


@dataclass(frozen=True)
class Paraphrase:
    """Rounds of paraphrase, the length tolerance in words, the stand-in's replacement rate."""

    iterations: int = 8
    tolerance: int = 50
    rate: float = 0.2


@dataclass(frozen=True)
class Windows:
    size: int = 50
    stride: int = 10
    mode: str = "clean"

    def __post_init__(self):
        if self.mode not in ("clean", "literal"):
            raise ValueError("mode is clean or literal")
        if self.size < 1 or self.stride < 1:
            raise ValueError("window size and stride are positive")


@dataclass(frozen=True)
class Classifier:
    test_size: float = 0.3
    seed: int = 42
    trees: int = 600
    depth: int = 6
    step: float = 0.05
    subsample: float = 0.85
    features_per_node: float = 0.8


@dataclass(frozen=True)
class Settings:
    corpus: Corpus = field(default_factory=Corpus)
    watermark: Watermark = field(default_factory=Watermark)
    paraphrase: Paraphrase = field(default_factory=Paraphrase)
    windows: Windows = field(default_factory=Windows)
    classifier: Classifier = field(default_factory=Classifier)
    #: (name, depths) of each experiment, and the static figures that the classifier sees.
    experiments: tuple[tuple[str, tuple[int, ...]], ...] = ()
    static_features: tuple[str, ...] = ()


#: Depth sets of the sweep, named by their depths: those from D1 on, then those up to D8.
EXPERIMENTS = tuple(("-".join(f"D{d}" for d in ds), ds) for ds in [tuple(range(1, k + 1)) for k in range(2, 9)] + [tuple(range(k, 9)) for k in range(2, 8)])

#: Settings that leave enough of the small synthetic corpus.
SMALL = Settings(Corpus(2, 120, None), Watermark(), Paraphrase(), Windows(20, 5), Classifier(trees=10))

_ALIASES = {"word_per_sample": "words_per_sample", "window_size": "size", "seeding_scheme": "scheme", "n_estimators": "trees", "max_depth": "depth", "learning_rate": "step", "random_state": "seed", "num_iterations": "iterations"}


def _known(cls, values: dict) -> dict:
    names = {f.name for f in fields(cls)}
    values = {_ALIASES.get(k, k): v for k, v in values.items()}
    return {k: v for k, v in values.items() if k in names}


def _flat(value) -> dict:
    """All scalar entries of a nested mapping, inner names only."""
    out: dict = {}
    for k, v in (value or {}).items():
        out |= _flat(v) if isinstance(v, dict) else {k: v}
    return out


def _listed(value) -> list[dict]:
    """Experiments as mappings; ``save`` writes them as pairs."""
    return [e if isinstance(e, dict) else {"name": e[0], "depths": e[1]} for e in value or ()]


def load(*paths: str | Path, base: Settings | None = None) -> Settings:
    """Settings from YAML files; unknown keys are ignored, later files win."""
    import yaml

    found: dict = {}
    for path in paths:
        found |= _flat(yaml.safe_load(Path(path).read_text(encoding="utf-8")))
    settings = base or Settings()
    parts = {f.name: replace(part, **_known(type(part), found)) for f in fields(settings) if is_dataclass(part := getattr(settings, f.name))}
    sets = [(e["name"], tuple(e["depths"])) for key in ("depth_experiments", "alternative_depth_experiments", "experiments") for e in _listed(found.get(key))]
    return Settings(**parts, experiments=tuple(sets) or settings.experiments, static_features=tuple(found.get("static_features") or settings.static_features))


def save(settings: Settings, path: str | Path) -> None:
    import yaml

    values = asdict(settings) | {"experiments": [{"name": n, "depths": list(d)} for n, d in settings.experiments], "static_features": list(settings.static_features)}
    Path(path).write_text(yaml.safe_dump(values, sort_keys=False), encoding="utf-8")
