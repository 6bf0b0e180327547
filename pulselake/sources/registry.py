"""Named places where databases lie: local or shared folders, and web roots."""

from __future__ import annotations

from dataclasses import dataclass, field
from urllib.parse import urlparse

#: Kinds of places.
LOCAL, WEB = "local", "web"


@dataclass(frozen=True)
class Source:
    """A named root. Local ones are absolute paths or URIs of a file system that Spark reads; web ones
    need a host."""

    name: str
    kind: str
    root: str

    def __post_init__(self) -> None:
        parts = urlparse(self.root)
        if self.kind == LOCAL:
            if not (self.root.startswith("/") or (parts.scheme and parts.scheme not in ("http", "https"))):
                raise ValueError(f"{self.name}: a local root is an absolute path or a URI")
        elif self.kind == WEB:
            if parts.scheme not in ("http", "https") or not parts.netloc:
                raise ValueError(f"{self.name}: a web root has a host")
        else:
            raise ValueError(f"kind {self.kind}: {LOCAL} or {WEB}")


@dataclass
class Registry:
    """Sources by name."""

    sources: dict[str, Source] = field(default_factory=dict)
    index_root: str | None = None

    def add(self, source: Source) -> None:
        if source.name in self.sources:
            raise ValueError(f"there is a source {source.name} already")
        self.sources[source.name] = source

    def remove(self, name: str) -> None:
        if name not in self.sources:
            raise KeyError(name)
        del self.sources[name]

    def reset(self) -> None:
        self.sources.clear()
        self.index_root = None

    def set_index(self, root: str) -> None:
        """Where the catalog of databases lies; checked like the root of a web source or a local one."""
        Source("index", WEB if root.startswith("http") else LOCAL, root)
        self.index_root = root.rstrip("/")

    def path(self, name: str, *parts: str) -> str:
        """The path of something below a source."""
        return "/".join([self.sources[name].root.rstrip("/"), *parts])
