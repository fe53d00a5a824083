"""Settings with their defaults and bounds, read from and written to TOML."""

from __future__ import annotations

import tomllib
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path
from urllib.parse import urlsplit


class ConfigError(ValueError):
    """A setting out of its bounds."""


@dataclass(frozen=True)
class ChunkSettings:
    target_chunk_size: int = 640
    max_chunk_size: int = 1024
    min_chunk_size: int = 160
    overlap_size: int = 80
    preserve_code_blocks: bool = True
    sentence_boundary_splitting: bool = True

    def problems(self):
        if not 100 <= self.target_chunk_size <= 2048:
            yield f"target_chunk_size must be 100 to 2048, not {self.target_chunk_size}"
        if not 200 <= self.max_chunk_size <= 4096:
            yield f"max_chunk_size must be 200 to 4096, not {self.max_chunk_size}"
        if not 50 <= self.min_chunk_size <= 1024:
            yield f"min_chunk_size must be 50 to 1024, not {self.min_chunk_size}"
        if not 0 <= self.overlap_size <= 512:
            yield f"overlap_size must be at most 512, not {self.overlap_size}"
        if self.max_chunk_size <= self.target_chunk_size:
            yield "max_chunk_size must be above target_chunk_size"
        if self.min_chunk_size >= self.target_chunk_size:
            yield "min_chunk_size must be below target_chunk_size"


@dataclass(frozen=True)
class EmbedSettings:
    protocol: str = "http"
    host: str = "localhost"
    port: int = 11434
    model: str = "nomic-embed-text:latest"
    batch_size: int = 16
    embedding_dimension: int = 768

    def problems(self):
        if self.protocol not in ("http", "https"):
            yield f"protocol must be http or https, not {self.protocol}"
        if not self.host.strip() or urlsplit(f"{self.protocol}://{self.host}").hostname is None or any(c.isspace() for c in self.host):
            yield f"host isn't part of a URL: {self.host}"
        if not 1 <= self.port <= 65535:
            yield f"port must be 1 to 65535, not {self.port}"
        if not self.model.strip():
            yield "model must not be blank"
        if not 1 <= self.batch_size <= 1000:
            yield f"batch_size must be 1 to 1000, not {self.batch_size}"
        if not 64 <= self.embedding_dimension <= 4096:
            yield f"embedding_dimension must be 64 to 4096, not {self.embedding_dimension}"

    @property
    def url(self) -> str:
        return f"{self.protocol}://{self.host}:{self.port}"


@dataclass(frozen=True)
class Settings:
    embedding: EmbedSettings = field(default_factory=EmbedSettings)
    chunking: ChunkSettings = field(default_factory=ChunkSettings)
    folder: Path = Path(".")

    def check(self) -> Settings:
        """Itself; the first problem is raised."""
        for p in (*self.embedding.problems(), *self.chunking.problems()):
            raise ConfigError(p)
        return self

    @property
    def file(self) -> Path:
        return self.folder / "config.toml"

    @property
    def catalog(self) -> str:
        return str(self.folder / "catalog")

    @property
    def vectors(self) -> str:
        return str(self.folder / "vectors")

    @property
    def cache(self) -> str:
        return str(self.folder / "cache")

    @classmethod
    def load(cls, folder: str | Path) -> Settings:
        """The folder's settings; a missing file or section has the defaults, a missing value its default."""
        at = Path(folder)
        return cls.parsed((at / "config.toml").read_text() if (at / "config.toml").exists() else "", at)

    @classmethod
    def parsed(cls, text: str, folder: Path) -> Settings:
        """The settings of a TOML text."""
        given = tomllib.loads(text)
        return cls(EmbedSettings(**given.get("embedding", {})), ChunkSettings(**given.get("chunking", {})), folder).check()

    def text(self) -> str:
        """As TOML, once they are within bounds."""
        self.check()
        said = lambda v: str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else '"' + str(v).replace("\\", "\\\\").replace('"', '\\"') + '"'
        parts = [f"[{name}]\n" + "".join(f"{k} = {said(v)}\n" for k, v in asdict(part).items()) for name, part in (("embedding", self.embedding), ("chunking", self.chunking))]
        return "\n".join(parts)

    def save(self) -> None:
        text = self.text()
        self.folder.mkdir(parents=True, exist_ok=True)
        self.file.write_text(text)


def asked(settings: Settings, ask: Callable[[str], str] = input, say: Callable[[str], None] = print, test: Callable[[EmbedSettings], None] | None = None) -> Settings:
    """Settings after a talk: each field of the embedding service with its value as the default, asked again until it is within bounds; then, if wanted, ``test`` tries the service."""
    now = settings.embedding
    for name, value in asdict(now).items():
        while True:
            given = ask(f"{name} [{value}]: ").strip()
            try:
                changed = replace(now, **{name: type(value)(given)}) if given else now
                wrong = [p for p in changed.problems() if p.startswith(name)]
            except ValueError:
                wrong = [f"{name} must be a number, not {given}"]
            if not wrong:
                now = changed
                break
            say(wrong[0])
    if test and ask("try the service now? [y/N]: ").strip().lower() in ("y", "yes"):
        try:
            test(now)
            say("the service answers and has the model")
        except Exception as e:  # the settings are kept, the service may come later
            say(f"the service is not available: {e}")
    return replace(settings, embedding=now).check()
