"""File extensions, languages and categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions of each language (fixed values).
EXTENSIONS = {
    "Python": "py pyi pyx", "C": "c h", "C++": "cc cpp cxx hpp hh", "C#": "cs", "Java": "java", "JavaScript": "js mjs cjs jsx", "Go": "go", "HTML": "html htm",
    "TypeScript": "ts tsx", "Ruby": "rb", "Rust": "rs", "PHP": "php", "Swift": "swift", "Kotlin": "kt kts", "Scala": "scala sc", "Shell": "sh bash zsh", "Perl": "pl pm",
    "Lua": "lua", "R": "r", "Dart": "dart", "Haskell": "hs", "Clojure": "clj", "Elixir": "ex exs", "Objective-C": "m", "Objective-C++": "mm", "Julia": "jl", "SQL": "sql",
    "CSS": "css", "SCSS": "scss", "Vue": "vue", "Svelte": "svelte",
    "JSON": "json", "YAML": "yaml yml", "TOML": "toml", "XML": "xml", "CSV": "csv", "TSV": "tsv", "Protocol Buffer": "proto", "INI": "ini cfg",
    "Markdown": "md markdown", "reStructuredText": "rst", "Text": "txt", "TeX": "tex",
}
#: Languages that are not code (fixed values).
DATA = ("JSON", "YAML", "TOML", "XML", "CSV", "TSV", "Protocol Buffer", "INI")
TEXT = ("Markdown", "reStructuredText", "Text", "TeX")
LANGUAGE_OF = {ext: language for language, exts in EXTENSIONS.items() for ext in exts.split()}


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def extension(path: Column) -> Column:
    """The last suffix of the base name without its dot; leading dots of a name start no suffix."""
    return F.regexp_extract(F.regexp_extract(path, "[^/]*$", 0), r"^\.*[^.].*\.([^.]*)$", 1)


def detect_language(path: Column) -> Column:
    """Null for an unknown extension."""
    return F.try_element_at(_map(LANGUAGE_OF), F.lower(extension(path)))


def category(language: Column) -> Column:
    return F.when(language.isin(*DATA), "data").when(language.isin(*TEXT), "text").otherwise("code")
