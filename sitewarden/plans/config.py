"""Settings in layers: defaults, a file, the environment, then what the caller sets."""

from __future__ import annotations

import os
import re
from dataclasses import asdict, dataclass, field, fields
from urllib.parse import urlsplit, urlunsplit

PREFIX, AGENT = "SITEWARDEN_", "sitewarden"
#: How one of a pool is chosen for a request.
ROTATIONS = ("round-robin", "random", "sticky-host", "off")


@dataclass
class Config:
    seed: str = ""
    concurrency: int = 4
    max_pages: int = 500  # 0: no limit
    max_depth: int = 0
    max_seconds: float = 0.0
    robots: bool = True
    probes: bool = False
    timeout: float = 15.0
    max_body_bytes: int = 5 << 20
    max_redirects: int = 10
    rate: float = 0.0
    follow_external: bool = False
    follow_nofollow: bool = False
    allow_subdomains: bool = False
    strip_query: bool = False
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    analyzers: list[str] = field(default_factory=list)
    skip: list[str] = field(default_factory=list)
    render: str = "raw"
    format: str = "json"
    adaptive_delay: bool = True
    user_agents: list[str] = field(default_factory=list)
    rotation: str = "round-robin"
    proxies: list[str] = field(default_factory=list)
    proxy_rotation: str = "round-robin"
    basic_auth: str = ""

    def __post_init__(self):
        if self.seed:
            parts = urlsplit(self.seed if "://" in self.seed else f"https://{self.seed}")
            user, _, host = parts.netloc.rpartition("@")
            self.basic_auth = self.basic_auth or user
            self.seed = urlunsplit((parts.scheme, host, parts.path, parts.query, ""))
        for name, known in (("render", ("raw", "headless")), ("format", ("json", "csv", "html")), ("rotation", ROTATIONS), ("proxy_rotation", ROTATIONS)):
            if getattr(self, name) not in known:
                raise ValueError(f"{name} is one of {', '.join(known)}, not {getattr(self, name)!r}")
        for proxy in self.proxies:
            if urlsplit(proxy).scheme != "http" or not urlsplit(proxy).hostname:
                raise ValueError(f"a proxy is http://[user:password@]host[:port], not {proxy!r}")
        for pattern in self.include + self.exclude:
            re.compile(pattern)
        if self.basic_auth and ":" not in self.basic_auth:
            raise ValueError("basic_auth is name:password")
        if self.concurrency < 1 or min(self.max_pages, self.max_depth, self.max_seconds, self.rate, self.timeout) < 0:
            raise ValueError("counts and times can't be negative, workers not zero")


def _cast(kind: str, value):
    if not isinstance(value, str):
        return value
    if kind.startswith("list"):
        return [x.strip() for x in value.split(",") if x.strip()]
    return {"int": int, "float": float, "bool": lambda v: v.lower() in ("1", "true", "yes", "on")}.get(kind, str)(value)


def load(path: str | None = None, env: dict | None = None, **given) -> Config:
    """Later layers win; unknown names are an error in a file and ignored in the environment."""
    kinds = {f.name: f.type for f in fields(Config)}
    layers = asdict(Config())
    if path:
        import yaml

        with open(path) as f:
            read = yaml.safe_load(f) or {}
        if unknown := set(read) - set(kinds):
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        layers |= read
    for name in kinds:
        if (value := (os.environ if env is None else env).get(PREFIX + name.upper())) is not None:
            layers[name] = value
    layers |= {k: v for k, v in given.items() if v is not None}
    return Config(**{k: _cast(kinds[k], v) for k, v in layers.items()})


def sample() -> str:
    """A settings file with every default, to start from."""
    lines = ["# Settings of a crawl; what is left out keeps its default."]
    for name, value in asdict(Config()).items():
        shown = {True: "true", False: "false"}.get(value, value) if isinstance(value, bool) else value
        lines.append(f'# {name}: {shown!r}'.replace("'", '"') if isinstance(shown, str) and not isinstance(value, bool) else f"# {name}: {shown}")
    return "\n".join(lines) + "\n"
