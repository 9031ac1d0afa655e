"""Document structure and training-data preparation on Spark.

Names are imported on first use, so that workers that need one module load no others."""

from importlib import import_module

__version__ = "0.1.0"
HOMES = {
    "api": ("Block", "Corpus", "Document", "Table", "detect_format", "parse", "parse_bytes", "parse_corpus"),
    "errors": ("FoliantError", "MissingBackendError", "ParseError", "PasswordRequiredError", "UnsupportedFormatError"),
    "options": ("FOOTNOTE_MODES", "TABLE_MODES", "Options"),
}
__all__ = ["__version__", *(name for names in HOMES.values() for name in names)]


def __getattr__(name: str):
    for module, names in HOMES.items():
        if name in names:
            return getattr(import_module(f"{__name__}.{module}"), name)
    raise AttributeError(name)
