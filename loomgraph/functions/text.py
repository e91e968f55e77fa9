"""Scalar functions on labels, identifiers and texts.

Built-in functions wherever they say the same; Arrow UDFs for Unicode normal forms and string metrics, which
Spark lacks. ``ascii_or`` keeps rows of plain ASCII on built-in functions.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ASCII = r"^[\x00-\x7F]*$"


def ascii_or(df: DataFrame, text: str, out: str, plain: Column, udf: Callable[[Column], Column]) -> DataFrame:
    """``df`` with ``out``: ``plain`` for ASCII (and null) values of ``text``, the Arrow function for all others."""
    is_plain = F.coalesce(F.col(text).rlike(_ASCII), F.lit(True))
    return df.filter(is_plain).withColumn(out, plain).unionByName(df.filter(~is_plain).withColumn(out, udf(F.col(text))))


def normalize_id(s: str | None) -> str | None:
    """Canonical identifier: caseless and compatibility-normal to a fixed point, runs of non-word characters to one ``_``."""
    if s is None:
        return None
    for _ in range(6):
        folded = unicodedata.normalize("NFKC", s.casefold())
        if folded == s:
            break
        s = folded
    return re.sub(r"_+", "_", re.sub(r"[^\w]+", "_", s)).strip("_")


@F.pandas_udf(T.StringType())
def normalize_id_udf(s: pd.Series) -> pd.Series:
    return s.map(normalize_id)


def with_id(df: DataFrame, text: str, out: str) -> DataFrame:
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9_]+", "_"), "_+", "_")
    return ascii_or(df, text, out, F.trim(plain, F.lit("_")), normalize_id_udf)


def label_norm(s: str | None) -> str:
    """Label for comparison: compatibility-normal, caseless, runs of anything but letters and digits to one space."""
    return re.sub(r"[\W_]+", " ", unicodedata.normalize("NFKC", s or "").casefold()).strip()


@F.pandas_udf(T.StringType())
def label_norm_udf(s: pd.Series) -> pd.Series:
    return s.map(label_norm)


def plain_norm(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def with_norm(df: DataFrame, text: str, out: str) -> DataFrame:
    return ascii_or(df, text, out, plain_norm(F.col(text)), label_norm_udf)


def fold(s: str | None) -> str:
    """Without diacritics: compatibility decomposition less its combining marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", s or "") if not unicodedata.combining(c))


@F.pandas_udf(T.StringType())
def fold_udf(s: pd.Series) -> pd.Series:
    return s.map(fold)


def with_fold(df: DataFrame, text: str, out: str) -> DataFrame:
    return ascii_or(df, text, out, F.coalesce(F.col(text), F.lit("")), fold_udf)


def tokens(folded: Column) -> Column:
    """Search tokens of a folded text."""
    return F.regexp_extract_all(F.lower(folded), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def entropy(norm: Column) -> Column:
    """Shannon entropy of a normalised label's characters, in bits."""
    chars = F.filter(F.split(norm, ""), lambda c: c != "")
    n = F.size(chars)
    share = lambda c: F.size(F.filter(chars, lambda d: d == c)) / n
    bits = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
    return F.when(n > 0, bits).otherwise(F.lit(0.0))


def shingles(text: Column, k: int = 3) -> Column:
    """Distinct character k-grams; a shorter text is its own."""
    grams = F.transform(F.sequence(F.lit(1), F.length(text) - (k - 1)), lambda i: F.substring(text, i, F.lit(k)))
    return F.when(F.length(text) < k, F.array(text)).otherwise(F.array_distinct(grams))


def bare_label(norm_label: Column) -> Column:
    """Without the run of parentheses at its end."""
    return F.regexp_replace(norm_label, r"[()]+$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*(\.[^./]+)$", 1))


# Families of languages that share a runtime, by file extension.
LANGUAGE_FAMILY = {
    ".py": "python", ".pyw": "python",
    ".js": "js", ".jsx": "js", ".mjs": "js", ".cjs": "js", ".ejs": "js", ".ts": "js", ".tsx": "js", ".mts": "js", ".cts": "js", ".vue": "js", ".svelte": "js",
    ".go": "go", ".rs": "rust",
    ".java": "jvm", ".kt": "jvm", ".kts": "jvm", ".scala": "jvm",
    ".c": "c", ".h": "c", ".cpp": "c", ".cc": "c", ".cxx": "c", ".hpp": "c",
    ".rb": "ruby", ".rake": "ruby", ".swift": "swift", ".cs": "dotnet", ".vb": "dotnet", ".php": "php", ".r": "r",
    ".cbl": "cobol", ".cob": "cobol", ".cobol": "cobol", ".cpy": "cobol", ".sol": "solidity", ".erl": "erlang", ".hrl": "erlang", ".escript": "erlang",
}
PAPER_EXTENSIONS = [".pdf"]
IMAGE_EXTENSIONS = [".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg"]
DOC_EXTENSIONS = [".md", ".mdx", ".qmd", ".skill", ".txt", ".rst", ".html", ".yaml", ".yml"]
CODE_EXTENSIONS = [*LANGUAGE_FAMILY, ".sql", ".json", ".sh", ".bash", ".lua", ".tf", ".dart", ".ex", ".exs", ".jl", ".zig", ".groovy"]
# Signals of a paper, of which three make one.
PAPER_SIGNALS = [
    r"(?i)\barxiv\b", r"(?i)\bdoi\s*:", r"(?i)\babstract\b", r"(?i)\bproceedings\b", r"(?i)\bjournal\b", r"(?i)\bpreprint\b", r"\\cite\{",
    r"\[\d+\]", r"\[\n\d+\n\]", r"(?i)eq\.\s*\d+|equation\s+\d+", r"\d{4}\.\d{4,5}", r"(?i)\bwe propose\b", r"(?i)\bliterature\b",
]
# Labels of builtins, and keys of JSON files, that are no entities.
BUILTIN_LABELS = [
    "str", "int", "float", "bool", "bytes", "bytearray", "complex", "object", "True", "False", "MagicMock", "Mock", "AsyncMock", "NonCallableMock",
    "NonCallableMagicMock", "PropertyMock", "patch", "sentinel", "Path", "Any", "Optional", "List", "Dict", "Set", "Tuple", "Union", "Callable", "Type", "ClassVar",
    "Final", "Literal", "Protocol", "Counter", "defaultdict", "OrderedDict", "datetime", "Enum", "os", "sys", "re", "json", "io", "abc", "typing",
    "Foundation", "SwiftUI", "UIKit", "AppKit", "Combine", "String", "Int", "Double", "Float", "Bool", "Data", "URL", "Date", "UUID", "Sendable", "Codable", "Decodable",
    "Encodable", "Equatable", "Hashable", "Identifiable", "Comparable", "AnyObject", "Error", "LocalizedError", "NSObject", "NSString", "NSError", "NSLock", "View",
    "Color", "Font", "DispatchQueue",
]
JSON_LABELS = [
    "start", "end", "name", "id", "type", "properties", "value", "key", "data", "items", "title", "description", "version", "dependencies", "devdependencies",
    "peerdependencies", "optionaldependencies", "bundleddependencies", "bundledependencies",
]


def family(path: Column) -> Column:
    """Language family of a file, null if not known."""
    pairs = F.create_map(*[F.lit(x) for kv in LANGUAGE_FAMILY.items() for x in kv])
    return F.try_element_at(pairs, extension(path))


def cross_language(a: Column, b: Column) -> Column:
    return F.coalesce(family(a) != family(b), F.lit(False))


def category(path: Column) -> Column:
    e = F.lower(F.regexp_extract(path, r"(\.[^.]*)$", 1))
    return F.when(e.isin(CODE_EXTENSIONS), "code").when(e.isin(PAPER_EXTENSIONS), "paper").when(e.isin(IMAGE_EXTENSIONS), "image").otherwise("doc")


def top_dir(path: Column) -> Column:
    clean = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(\./)+", "")
    return F.when(clean.contains("/"), F.split(clean, "/")[0]).otherwise(".")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda x: x != "")).cast("long")


def paper_signals(text: Column) -> Column:
    head = F.substring(text, 1, 3000)
    return sum((head.rlike(p).cast("int") for p in PAPER_SIGNALS), F.lit(0))


def html_text(html: Column) -> Column:
    """Visible text of a page, at most 8000 characters."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", ""), r"(?is)<style[^>]*>.*?</style>", "")
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]+>", " "), r"\s+", " ")), 1, 8000)


def url_type(url: Column) -> Column:
    host = F.rtrim(F.lower(F.regexp_extract(url, r"^[^:/?#]+://(?:[^/?#@]*@)?([^:/?#]*)", 1)), F.lit("."))
    path = F.lower(F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1))
    is_host = lambda *names: sum((F.coalesce((host == n) | host.endswith("." + n), F.lit(False)).cast("int") for n in names), F.lit(0)) > 0
    return (
        F.when(is_host("twitter.com", "x.com"), "tweet").when(is_host("arxiv.org"), "arxiv").when(is_host("github.com"), "github")
        .when(is_host("youtube.com", "youtu.be"), "youtube").when(path.endswith(".pdf"), "pdf")
        .when(path.rlike(r"\.(png|jpg|jpeg|webp|gif)$"), "image").otherwise("webpage")
    )


def sane_number(value: Column) -> Column:
    """Finite and not negative, else 1."""
    n = value.try_cast("double")
    return F.when(n.isNull() | F.isnan(n) | (F.abs(n) == float("inf")) | (n < 0), F.lit(1.0)).otherwise(n)


def sanitize_label(text: Column) -> Column:
    """Without control characters, at most 256 long."""
    return F.substring(F.regexp_replace(text, r"[\x00-\x1F\x7F]", ""), 1, 256)


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    taken, own = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                own.append(c)
                break
    m = len(own)
    if not m:
        return 0.0
    other = [b[j] for j in range(len(b)) if taken[j]]
    moved = sum(x != y for x, y in zip(own, other)) // 2
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    j = jaro(a, b)
    same = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        same += 1
    return j + same * 0.1 * (1 - j) if j > 0.7 else j


def damerau(a: str, b: str) -> int:
    """Edit distance with transpositions of neighbours, unrestricted."""
    last: dict[str, int] = {}
    most = len(a) + len(b)
    d = [[most] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i in range(1, len(a) + 1):
        seen = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), seen
            cost = a[i - 1] != b[j - 1]
            if not cost:
                seen = j
            d[i + 1][j + 1] = min(d[i][j] + cost, d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1))
        last[a[i - 1]] = i
    return d[len(a) + 1][len(b) + 1]


@F.pandas_udf(T.DoubleType())
def jaro_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro(x, y) for x, y in zip(a, b)])


@F.pandas_udf(T.DoubleType())
def jaro_winkler_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_winkler(x, y) for x, y in zip(a, b)])


@F.pandas_udf(T.LongType())
def damerau_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([damerau(x, y) for x, y in zip(a, b)])


def digit_runs(text: Column) -> Column:
    """The numbers in a label, without leading zeros, as a sorted list."""
    runs = F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0))
    return F.array_sort(F.transform(runs, lambda x: F.when(F.ltrim(x, F.lit("0")) == "", "0").otherwise(F.ltrim(x, F.lit("0")))))
