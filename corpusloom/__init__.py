"""corpusloom: a Spark engine that turns crawled pages into a clean, deduplicated text corpus."""

from corpusloom.library import WebScraper, clean_filename, extract_text_content

__version__ = "0.2.0"
__all__ = ["WebScraper", "clean_filename", "extract_text_content"]
