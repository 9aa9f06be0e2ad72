"""Validated settings: naming rules, sites, prices. Rejected before any plan is built."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from urllib.parse import urlsplit

# Exception kinds, review and scoring constants of the rule model.
EXCEPTION_KINDS = ("urls", "emails", "file_names", "domains", "handles", "hashtags")
SEVERITY_WEIGHT = {"high": 10, "medium": 3, "low": 1}
VISIBILITY_FACTOR = {"visible": 1.0, "hidden": 1.0, "metadata": 1.0, "spoken": 1.0}
PRICE_IN, PRICE_OUT = 0.30, 2.50
REVIEW_BATCH = 20
HOST = re.compile(r"(?=.{1,253}$)(?!-)[a-z0-9-]{1,63}(?<!-)(\.(?!-)[a-z0-9-]{1,63}(?<!-))+")


class ConfigError(ValueError):
    pass


def cleaned(values) -> tuple[str, ...]:
    """Stripped, without empty ones, first occurrence of each."""
    return tuple(dict.fromkeys(v for v in map(str.strip, values) if v))


@dataclass(frozen=True)
class Market:
    approved: tuple[str, ...] = ()
    disallowed: tuple[str, ...] = ()


@dataclass(frozen=True)
class RuleConfig:
    canonical: str
    allowed_casings: tuple[str, ...] = ()
    disallowed: tuple[str, ...] = ()
    attached_forms_ok: bool = True
    fuzzy: bool = True
    max_edit_distance: int = 1
    ignore_words: tuple[str, ...] = ()
    exceptions: tuple[str, ...] = EXCEPTION_KINDS
    locales: dict[str, Market] = field(default_factory=dict)
    cross_market: str = "low"
    severity: str = "high"

    def __post_init__(self):
        name = self.canonical
        if not 2 <= len(name) <= 100:
            raise ConfigError("the name must have 2 to 100 characters")
        if self.max_edit_distance not in (1, 2):
            raise ConfigError("the edit distance must be 1 or 2")
        if odd := set(self.exceptions) - set(EXCEPTION_KINDS):
            raise ConfigError(f"unknown exceptions: {sorted(odd)}")
        if self.cross_market not in ("off", "low", "medium", "high") or self.severity not in SEVERITY_WEIGHT:
            raise ConfigError("unknown severity")
        casings = cleaned(self.allowed_casings)
        if name not in casings:
            casings = (name, *casings)
        if odd := [c for c in casings if c.casefold() != name.casefold()]:
            raise ConfigError(f"a casing must spell the name: {', '.join(odd)}")
        bad = cleaned(self.disallowed)
        if odd := [d for d in bad if d.casefold() == name.casefold()]:
            raise ConfigError(f"{odd[0]!r} only differs in case; leave it out of the allowed casings instead")
        for key, value in (("allowed_casings", casings), ("disallowed", bad), ("ignore_words", cleaned(self.ignore_words))):
            object.__setattr__(self, key, value)

    @classmethod
    def from_dict(cls, spec: dict) -> RuleConfig:
        spec = dict(spec)
        fuzzy = spec.pop("fuzzy", {})
        if isinstance(fuzzy, dict):
            spec["fuzzy"] = fuzzy.get("enabled", True)
            spec["max_edit_distance"] = fuzzy.get("max_edit_distance", 1)
        else:
            spec["fuzzy"] = fuzzy
        spec["locales"] = {k: v if isinstance(v, Market) else Market(tuple(v.get("approved", ())), tuple(v.get("disallowed", ()))) for k, v in spec.get("locales", {}).items()}
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in spec.items()})

    def to_dict(self) -> dict:
        """The nested form that rules are exported in."""
        return {
            "canonical": self.canonical,
            "allowed_casings": list(self.allowed_casings),
            "disallowed": list(self.disallowed),
            "attached_forms_ok": self.attached_forms_ok,
            "fuzzy": {"enabled": self.fuzzy, "max_edit_distance": self.max_edit_distance},
            "ignore_words": list(self.ignore_words),
            "exceptions": list(self.exceptions),
            "locales": {k: {"approved": list(m.approved), "disallowed": list(m.disallowed)} for k, m in self.locales.items()},
            "cross_market": self.cross_market,
        }


@dataclass(frozen=True)
class RuleVersion:
    """One version of a rule; the history is append-only."""

    rule_id: int
    key: str
    version: int
    config: RuleConfig
    enabled: bool = True

    def changed(self, config: RuleConfig, enabled: bool | None = None) -> RuleVersion:
        return replace(self, config=config, version=self.version + 1, enabled=self.enabled if enabled is None else enabled)


@dataclass(frozen=True)
class SiteConfig:
    name: str
    start_urls: tuple[str, ...]
    allowed_domains: tuple[str, ...]
    include_patterns: tuple[str, ...] = ()
    exclude_patterns: tuple[str, ...] = ()
    max_pages: int = 500
    use_sitemap: bool = True
    independent: bool = True
    request_interval_s: float = 2.0
    respect_robots: bool = True

    def __post_init__(self):
        domains = cleaned(d.lower() for d in self.allowed_domains)
        starts = cleaned(self.start_urls)
        if not starts or not domains:
            raise ConfigError("a site needs a start URL and a domain")
        for d in domains:
            if not HOST.fullmatch(d):
                raise ConfigError(f"not a host name: {d}")
        for u in starts:
            parts = urlsplit(u)
            if parts.scheme not in ("http", "https") or not parts.hostname:
                raise ConfigError(f"not an http(s) URL: {u}")
            if parts.hostname.lower() not in domains:
                raise ConfigError(f"a start URL is not on an allowed domain: {u}")
        for p in (*self.include_patterns, *self.exclude_patterns):
            try:
                re.compile(p)
            except re.error as e:
                raise ConfigError(f"not a pattern: {p}") from e
        if self.max_pages < 1 or self.request_interval_s < 0:
            raise ConfigError("the page limit and the interval must be positive")
        if self.independent and (self.request_interval_s < 1 or not self.respect_robots):
            raise ConfigError("an independent check keeps 1 s between requests and respects robots.txt")
        object.__setattr__(self, "allowed_domains", domains)
        object.__setattr__(self, "start_urls", starts)
