"""Settings: defaults, then a YAML file, then the environment, then what the caller sets."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields
from pathlib import Path

from auditloom.functions.columns import glob_regex
from auditloom.report.writers import FORMATS

FILE_NAME, PREFIX = "auditloom.yml", "AUDITLOOM_"


@dataclass
class Config:
    max_depth: int = 5
    max_pages: int = 500
    concurrency: int = 10
    request_timeout: float = 10.0
    rate_limit: int = 50
    user_agent: str = "auditloom/1.0"
    respect_robots: bool = True
    output: str = "terminal"
    output_file: str = ""
    fail_on: str = ""
    browser_mode: bool = False
    browserless_url: str = "http://localhost:3000"
    lighthouse: bool = False
    lighthouse_mode: str = "psi"
    psi_api_key: str = ""
    psi_strategy: str = "mobile"
    log_level: str = "info"
    log_format: str = "pretty"
    filter_severity: str = ""
    filter_category: str = ""
    parallel_domains: int = 3
    metrics_push_url: str = ""
    checkpoint_file: str = ""
    resume_file: str = ""
    incremental_file: str = ""
    rules_file: str = ""
    schema_path: str = ""
    save_baseline: str = ""
    compare_baseline: str = ""
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)

    def formats(self) -> list[str]:
        return [x.strip() for x in self.output.split(",") if x.strip()]

    def validate(self) -> "Config":
        for name in ("max_depth", "max_pages", "concurrency", "rate_limit", "parallel_domains"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1, got {getattr(self, name)}")
        if self.request_timeout <= 0:
            raise ValueError("request_timeout must be positive")
        one_of = {"fail_on": ("", "critical", "warning", "info", "any"), "log_level": ("debug", "info", "warn", "error"), "log_format": ("pretty", "json"), "lighthouse_mode": ("psi", "browserless"), "psi_strategy": ("mobile", "desktop")}
        for name, allowed in one_of.items():
            if getattr(self, name) not in allowed:
                raise ValueError(f"invalid {name} {getattr(self, name)!r}")
        for f in self.formats():
            if f not in FORMATS:
                raise ValueError(f"invalid output format {f!r}")
        for p in [*self.include, *self.exclude]:
            if glob_regex(p) is None:
                raise ValueError(f"invalid pattern {p!r}")
        return self


#: Keys of the settings file by section, where they differ from the setting's name.
_YAML = {
    "crawl": {"max_depth": "max_depth", "max_pages": "max_pages", "concurrency": "concurrency", "respect_robots": "respect_robots", "exclude": "exclude", "include": "include", "rate_limit": "rate_limit", "timeout": "request_timeout", "user_agent": "user_agent"},
    "output": {"formats": "output", "file": "output_file", "fail_on": "fail_on"},
    "filter": {"severity": "filter_severity", "category": "filter_category"},
    "lighthouse": {"enabled": "lighthouse", "mode": "lighthouse_mode", "strategy": "psi_strategy"},
    "browser": {"enabled": "browser_mode", "browserless_url": "browserless_url"},
    "rules": {"file": "rules_file"},
    "baseline": {"save": "save_baseline", "compare": "compare_baseline"},
}


def seconds(text) -> float:
    """``10``, ``10s``, ``500ms`` or ``1m30s`` in seconds."""
    import re

    if isinstance(text, (int, float)):
        return float(text)
    if re.fullmatch(r"\d+(\.\d+)?", text):
        return float(text)
    if not re.fullmatch(r"(\d+(\.\d+)?(ms|s|m|h))+", text):
        raise ValueError(f"invalid duration {text!r}")
    unit = {"ms": 0.001, "s": 1, "m": 60, "h": 3600}
    return sum(float(n) * unit[u] for n, _, u in re.findall(r"(\d+(\.\d+)?)(ms|s|m|h)", text))


def _typed(name: str, value, kind: str):
    if name == "request_timeout":
        return seconds(value)
    if kind == "int":
        return int(value)
    if kind == "bool":
        if isinstance(value, bool):
            return value
        if str(value).lower() in ("true", "1", "t", "yes"):
            return True
        if str(value).lower() in ("false", "0", "f", "no"):
            return False
        raise ValueError(f"invalid {name} {value!r}")
    if name in ("include", "exclude"):
        return list(value)
    return ",".join(value) if isinstance(value, list) else str(value)


def find_file(explicit: str = "") -> Path | None:
    """The named file, else one in the working folder, else one at home."""
    if explicit:
        return Path(explicit)
    return next((p for p in (Path.cwd() / FILE_NAME, Path.home() / FILE_NAME) if p.is_file()), None)


def load_config(file: str = "", env: dict | None = None, **flags) -> Config:
    env = dict(os.environ) if env is None else env
    kinds = {f.name: f.type for f in fields(Config)}
    values: dict = {}
    p = find_file(file)
    if p is not None:
        import yaml

        raw = yaml.safe_load(p.read_text()) or {}
        for section, keys in _YAML.items():
            for key, name in keys.items():
                v = (raw.get(section) or {}).get(key)
                if v is not None:
                    values[name] = _typed(name, v, kinds[name])
    for name, kind in kinds.items():
        v = env.get(PREFIX + name.upper())
        if v is not None and name not in ("include", "exclude"):
            values[name] = _typed(name, v, kind)
    for name, v in flags.items():
        if v is not None:
            values[name] = _typed(name, v, kinds[name])
    return Config(**values).validate()


def dump(config: Config) -> str:
    return "".join(f"{f.name:<18} {getattr(config, f.name)}\n" for f in fields(Config))
