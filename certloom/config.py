"""What a scan is asked to look for. Plans are compiled from it; it is never data."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field
from urllib.parse import urlsplit


class ConfigError(ValueError):
    pass


#: Words of account security, the default keywords.
ACTION_TERMS = ("account", "auth", "billing", "invoice", "login", "password", "reset", "secure", "signin", "support", "verify", "wallet")
DEFAULT_KEYWORDS = ("login", "verify", "secure", "account", "reset", "support", "wallet", "password", "billing", "invoice", "auth", "signin")


def _clean(values: list[str], what: str) -> list[str]:
    out = list(dict.fromkeys(v.strip().lower() for v in values))
    if "" in out:
        raise ConfigError(f"{what} has a blank value")
    return out


def ct_base_url(url: str) -> str:
    """A log's base URL: no /checkpoint, no slash at the end."""
    url = url.strip()
    if urlsplit(url).scheme not in ("http", "https") or not urlsplit(url).netloc:
        raise ConfigError(f"not an http(s) URL: {url}")
    return url.rstrip("/").removesuffix("/checkpoint").rstrip("/")


@dataclass
class Outputs:
    webhook_url: str | None = None
    webhook_signing_secret: str | None = None
    slack_webhook_url: str | None = None


@dataclass
class Dns:
    enabled: bool = False
    takeover: bool = False
    #: Lookups under way at once, over all tasks.
    concurrency: int = 16
    #: Lookups a second, over all tasks; no limit if it is not set.
    per_second: float | None = None
    #: A folder of answers, which later scans ask again only when they have expired.
    cache: str | None = None
    #: Seconds for which it is kept that a name has no address.
    negative_ttl: int = 900


@dataclass
class TrustedLog:
    origin: str
    base_url: str
    public_key: str
    log_id: str | None = None


@dataclass
class Ct:
    trusted_logs: list[TrustedLog] = field(default_factory=list)


@dataclass
class Rules:
    min_score: int = 0
    min_alert_score: int = 0
    allowlist_suffixes: list[str] = field(default_factory=list)


@dataclass
class Config:
    brands: list[str] = field(default_factory=list)
    official_domains: list[str] = field(default_factory=list)
    keywords: list[str] = field(default_factory=lambda: list(DEFAULT_KEYWORDS))
    allowlist: list[str] = field(default_factory=list)
    #: A file of public suffix rules, in place of those that come with Spark.
    public_suffixes: str | None = None
    #: Look-alike letters as JSON text, in place of the built-in ones.
    lookalikes: str | None = None
    outputs: Outputs = field(default_factory=Outputs)
    dns: Dns = field(default_factory=Dns)
    ct: Ct = field(default_factory=Ct)
    rules: Rules = field(default_factory=Rules)

    def validated(self) -> Config:
        """A copy with values in normal form; ConfigError if one is out of range."""
        for name in ("min_score", "min_alert_score"):
            if not 0 <= getattr(self.rules, name) <= 100:
                raise ConfigError(f"rules.{name} must be 0 to 100")
        if not 1 <= self.dns.concurrency <= 128:
            raise ConfigError("dns.concurrency must be 1 to 128")
        if self.dns.per_second is not None and not self.dns.per_second > 0 or self.dns.negative_ttl < 0:
            raise ConfigError("dns.per_second must be over 0 and dns.negative_ttl not under it")
        for url in (self.outputs.webhook_url, self.outputs.slack_webhook_url):
            if url is not None and (urlsplit(url).scheme not in ("http", "https") or not urlsplit(url).netloc):
                raise ConfigError("outputs need http(s) URLs")
        if self.outputs.webhook_signing_secret is not None and not self.outputs.webhook_signing_secret.strip():
            raise ConfigError("outputs.webhook_signing_secret is blank")
        logs = [dataclasses.replace(x, base_url=ct_base_url(x.base_url)) for x in self.ct.trusted_logs]
        suffixes = [s.strip(".") for s in _clean(self.rules.allowlist_suffixes, "allowlist_suffixes")]
        return dataclasses.replace(
            self,
            brands=_clean(self.brands, "brands"),
            official_domains=_clean(self.official_domains, "official_domains"),
            keywords=_clean(self.keywords, "keywords"),
            allowlist=_clean(self.allowlist, "allowlist"),
            ct=Ct(logs),
            rules=dataclasses.replace(self.rules, allowlist_suffixes=list(dict.fromkeys(suffixes))),
        )

    def overridden(self, min_score: int | None = None, allowlist_suffixes: list[str] = ()) -> Config:
        """min_score replaces, suffixes are added."""
        rules = dataclasses.replace(self.rules, min_score=self.rules.min_score if min_score is None else min_score, allowlist_suffixes=[*self.rules.allowlist_suffixes, *allowlist_suffixes])
        return dataclasses.replace(self, rules=rules).validated()

    def trusted_log(self, base_url: str) -> TrustedLog | None:
        wanted = ct_base_url(base_url)
        return next((x for x in self.ct.trusted_logs if ct_base_url(x.base_url) == wanted), None)


_PARTS = {"outputs": Outputs, "dns": Dns, "ct": Ct, "rules": Rules}


def _build(kind: type, values: dict, at: str):
    if not isinstance(values, dict):
        raise ConfigError(f"{at or 'config'} must be a mapping")
    names = {f.name for f in dataclasses.fields(kind)}
    if unknown := set(values) - names:
        raise ConfigError(f"unknown key {at}{sorted(unknown)[0]}")
    return kind(**{k: _build(_PARTS[k], v or {}, f"{k}.") if kind is Config and k in _PARTS else [_build(TrustedLog, x, "ct.trusted_logs.") for x in v or []] if k == "trusted_logs" else v for k, v in values.items() if v is not None or kind is not Config})


def from_mapping(values: dict) -> Config:
    """Unknown keys are errors."""
    return _build(Config, values, "").validated()


def from_yaml(text: str) -> Config:
    """Needs a YAML parser; where there is none, JSON is read, which is YAML too, and anything else is an error that says so."""
    try:
        import yaml
    except ImportError:
        import json

        try:
            return from_mapping(json.loads(text))
        except json.JSONDecodeError as e:
            raise ConfigError(f"there is no YAML parser (PyYAML) here, and the configuration is not JSON: {e}") from e
    return from_mapping(yaml.safe_load(text) or {})


def demo() -> Config:
    brands = ["paypal", "microsoft", "github"]
    return Config(brands=brands, official_domains=[f"{b}.com" for b in brands], allowlist=["github.com", "microsoft.com", "paypal.com", "login.microsoftonline.com"]).validated()
