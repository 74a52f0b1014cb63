"""Settings of a run, with the defaults of the pipeline."""

from __future__ import annotations

from dataclasses import dataclass

# Defaults that results depend on.
MODEL_INPUT_CHARS = 10_000
EMBED_INPUT_CHARS = 6_000
EXCERPT_CHARS = 8_000
PREVIEW_CHARS = 1_500
MIN_ARTICLE_CHARS = 80
SLUG_CHARS = 50
RECALL_WIDTH = 5
SIMILARITY = 0.85
FILE_LIMIT = 300
RULE = "-" * 50
TRUNCATED = "\n\n[... content truncated for processing ...]"
NO_MATCH_REASON = "Unparseable decision; saved by default"


def scope_of(start: str, subdomain: str | None = None, prefix: str | None = None) -> tuple[str, str | None]:
    """Host and path prefix that a crawl keeps to: those of the option ``host`` or ``host/path``, else the start's host.

    A prefix that is given wins over the option's path.
    """
    host, _, path = (subdomain or "").strip().lower().partition("/")
    host = host.strip() or start.split("://", 1)[-1].split("/", 1)[0].split("?", 1)[0].split("#", 1)[0].lower()
    return host, prefix or (f"/{path.strip()}" if path.strip() else None)


@dataclass(frozen=True)
class Config:
    """Options of a crawl and of the agent; a threshold of 0 is a threshold like any other."""

    max_pages: int = 300
    prefix: str | None = None
    include_external: bool = False
    delay: float = 0.5
    timeout: float = 10.0
    user_agent: str = "corpusloom/0.2"
    use_agent: bool = True
    skip_clean: bool = False
    similarity: float = SIMILARITY
    top_k: int = RECALL_WIDTH
    max_input: int = MODEL_INPUT_CHARS
    max_embed: int = EMBED_INPUT_CHARS

    def __post_init__(self) -> None:
        if not 1 <= self.max_pages <= 1000:
            raise ValueError("max_pages must lie between 1 and 1000")
        if not -1.0 <= self.similarity <= 1.0:
            raise ValueError("similarity must lie between -1 and 1")
