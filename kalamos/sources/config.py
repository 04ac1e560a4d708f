"""Run configuration from YAML: a checked ``data`` section and open sections for whatever trains on its tables.

Only settings that a plan of this engine reads have a row in ``SETTINGS``; each row says how a value is read, what
holds without one and what it must fulfil.  Other names, and the sections of a trainer, are carried along as YAML
gives them, so that a run's configuration stays one file.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Mapping
from pathlib import Path
from types import SimpleNamespace
from typing import Any, NamedTuple

log = logging.getLogger(__name__)


class Setting(NamedTuple):
    kind: type
    default: Any
    holds: Callable[[Any], bool] = lambda value: True
    says: str = ""


def _one_of(*names: str) -> tuple[Callable[[Any], bool], str]:
    return (lambda value: value in names), "one of " + ", ".join(names)


_COUNT = (lambda value: value >= 0), "0 or more"
_OPEN_SHARE = (lambda value: 0 < value < 1), "between 0 and 1, both excluded"

# Names and defaults that configuration files rely on.
SETTINGS: dict[str, Setting] = {
    # where the tables lie
    "data_dir": Setting(str, "data/raw"),
    "train_file": Setting(str, "train.csv"),
    "test_file": Setting(str, "test.csv"),
    "prepared_file": Setting(str, None),
    "holdout_doc_ids_file": Setting(str, None),
    # which rows
    "data_mode": Setting(str, "document", *_one_of("document", "sentence_only", "extended_sentence", "mixed", "prepared")),
    "prepared_granularity": Setting(str, None),
    "include_invalid_anchors": Setting(bool, False),
    "min_sentence_words": Setting(int, 2, *_COUNT),
    "max_sentence_words": Setting(int, 150, *_COUNT),
    "filter_quality": Setting(bool, False),
    "min_translation_chars": Setting(int, 5, *_COUNT),
    "max_length_ratio": Setting(float, 10.0, *_COUNT),
    # what becomes of their texts
    "skip_source_normalization": Setting(bool, False),
    "strip_determinatives": Setting(bool, False),
    "tag_sumerograms": Setting(bool, False),
    "remove_gaps": Setting(bool, False),
    "strip_homophone_subscripts": Setting(bool, True),
    "use_dictionary_gloss": Setting(bool, False),
    "max_glosses": Setting(int, 8, *_COUNT),
    # how they are split
    "val_split": Setting(float, 0.1, *_OPEN_SHARE),
    "val_split_strategy": Setting(str, "random", *_one_of("random", "doc_id")),
    "val_group_column": Setting(str, "doc_id"),
}


def _yaml(text: str) -> Any:
    import yaml

    return yaml.safe_load(text)


def read_value(setting: Setting, value: Any) -> Any:
    """``value`` (from YAML or a command line) as the setting's kind; ``ValueError`` where it cannot be."""
    if isinstance(value, str) and setting.kind is not str:
        value = _yaml(value)
    if value is None or (setting.kind is str and setting.default is None and value in ("null", "none", "None", "")):
        if setting.default is not None:
            raise ValueError("a value is needed")
        return None
    if setting.kind is bool and value in (0, 1):
        value = bool(value)
    if setting.kind is float and isinstance(value, int) and not isinstance(value, bool):
        value = float(value)
    if setting.kind is str and not isinstance(value, str):
        value = str(value)
    if type(value) is not setting.kind:
        raise ValueError(f"{value!r} is not of kind {setting.kind.__name__}")
    return value


class DataConfig(SimpleNamespace):
    """The ``data`` section: every known setting by name, and the other names given."""

    def __init__(self, **given: Any) -> None:
        super().__init__(**{name: setting.default for name, setting in SETTINGS.items()})
        for name, value in given.items():
            if name not in SETTINGS:
                log.warning("data.%s is not read by any plan", name)
            setattr(self, name, read_value(SETTINGS[name], value) if name in SETTINGS else value)

    def check(self) -> DataConfig:
        for name, setting in SETTINGS.items():
            value = getattr(self, name)
            if value is not None and not setting.holds(value):
                raise ValueError(f"data.{name} is {value!r}; it must be {setting.says}")
        return self


class Config(SimpleNamespace):
    """All sections; ``data`` is a :class:`DataConfig`, the others are plain namespaces."""

    def __init__(self, sections: Mapping[str, Mapping[str, Any]] | None = None) -> None:
        given = dict(sections or {})
        super().__init__(data=DataConfig(**given.pop("data", {})), **{name: SimpleNamespace(**part) for name, part in given.items()})


def load(path: str | Path, folders: Iterable[str | Path] = ()) -> Config:
    """The checked configuration in ``path``; a bare name is also looked for anywhere below ``folders``, where it must
    stand once."""
    places = [Path(path)] if Path(path).exists() else [hit for folder in folders for hit in Path(folder).rglob(Path(path).name)]
    if len(places) != 1:
        raise FileNotFoundError(f"{path}: {'found more than once' if places else 'no such configuration'}")
    sections = _yaml(places[0].read_text(encoding="utf-8")) or {}
    if not isinstance(sections, dict):
        raise ValueError(f"{places[0]}: top-level must be a mapping")
    if odd := [name for name, part in sections.items() if not isinstance(part, dict)]:
        raise ValueError(f"{places[0]}: the sections {odd} must be mappings")
    config = Config(sections)
    config.data.check()
    return config


def override(config: Config, words: list[str]) -> Config:
    """Apply ``--section.name value`` words.  A setting of ``data`` is read as its kind, one of an open section as
    YAML.  What is unknown or cannot be read is left as it was, with a warning."""
    ahead = iter(words)
    for word in ahead:
        value = next(ahead, None)
        section, _, name = word.removeprefix("--").partition(".")
        part = getattr(config, section, None)
        if value is None or not name or (part is None and section == "data") or (section == "data" and name not in SETTINGS):
            log.warning("%s changes nothing: %s", word, "it has no value" if value is None else "no such setting")
            continue
        try:
            read = read_value(SETTINGS[name], value) if section == "data" else _yaml(value)
        except ValueError as reason:
            log.warning("%s changes nothing: %s", word, reason)
            continue
        if part is None:
            part = SimpleNamespace()
            setattr(config, section, part)
        setattr(part, name, read)
    return config


# The switches of the normalisation chain and the settings that turn them.
SWITCHES = {"strip_determinatives": "strip_determinatives", "tag_sumerograms": "tag_sumerograms", "remove_gaps": "remove_gaps", "strip_homophones": "strip_homophone_subscripts"}


def normalisation_flags(data: Any) -> dict[str, bool]:
    """The switches of the normalisation chain as the chain calls them."""
    return {switch: getattr(data, setting) for switch, setting in SWITCHES.items()}


def active_ablations(data: Any) -> list[str]:
    """The switches that change more than a clean run does."""
    return [setting for setting in SWITCHES.values() if getattr(data, setting) and not SETTINGS[setting].default]
