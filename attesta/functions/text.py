"""Text functions as columns. Unless a function says otherwise, null gives null."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


def folded(text: Column) -> Column:
    """Lower case, every run of other characters than letters, digits and `_` a space, trimmed. Stays in the JVM; see folded_nfkc for full Unicode folding."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "))


def fold(text: str) -> str:
    """NFKC, case folding, runs of other characters than words' and Han ones a space, trimmed."""
    return _OTHER.sub(" ", unicodedata.normalize("NFKC", text).casefold()).strip()


_OTHER = re.compile("[^\\w\u3400-\u9fff]+")


@pandas_udf(StringType())
def folded_nfkc(text: pd.Series) -> pd.Series:
    """As fold, in Arrow batches: no built-in function offers NFKC or Unicode case folding."""
    return text.map(lambda x: None if x is None else fold(x))


def squeezed(text: Column) -> Column:
    """Runs of white space become one space, the ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def review_key(text: Column) -> Column:
    return F.lower(squeezed(text))


def clean_to(text: Column, length: int) -> Column:
    """Squeezed and cut to a number of characters."""
    return F.substring(squeezed(text), 1, length)


def bounded(text: Column, first: int = 4096, last: int = 2000) -> Column:
    """Cut, then trimmed, then cut again: the order matters for long leading white space."""
    return F.substring(F.trim(F.substring(text, 1, first)), 1, last)


def chunks(text: Column, size: int = 900, step: int = 700, limit: int = 6000) -> Column:
    """Overlapping pieces of `size` characters, one every `step` that starts within the first `limit`; pieces too short to say something go. An empty array for empty text."""
    n = F.least(F.length(text), F.lit(limit))
    cut = F.transform(F.sequence(F.lit(0), n - 1, F.lit(step)), lambda at: F.substring(text, at + 1, F.lit(size)))
    return F.when(n > 0, F.filter(cut, lambda piece: F.length(piece) >= least_length(text))).when(n == 0, F.array().cast("array<string>"))


def least_length(text: Column) -> Column:
    """Characters that a text of this script needs to say something: 6 with Han characters, 16 without."""
    return F.when(text.rlike("[\\u3400-\\u9fff]"), 6).otherwise(16)


def unfenced(text: Column) -> Column:
    """The inside of a ```json fence, or the trimmed text itself."""
    return F.trim(F.regexp_replace(F.trim(text), r"(?s)^```(?:json)?\s*(.*?)\s*```$", "$1"))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def section_id(page: Column, url: Column, text: Column) -> Column:
    """A page's name and 16 hex digits of the digest of address and text."""
    return F.concat(page, F.lit(":"), F.substring(F.sha2(F.concat(url, text), 256), 1, 16))


def claims_map(text: Column) -> Column:
    """`name: value; name: value` as a map."""
    return F.str_to_map(text, F.lit(r";\s*"), F.lit(r":\s"))


def has_secret(text: Column) -> Column:
    """Whether a text holds what looks like a credential."""
    return text.rlike(r"(?i)(?:password|passwd|cookie|authorization|token|secret|api[_-]?key)[\"']?\s*[:=]\s*[\"']?[A-Za-z0-9._-]{8,}")


#: Names of credentials that stand before `:` or `=`, bearer tokens, and two cookies in a row.
CREDENTIALS = r"password|passwd|cookie|set-cookie|access[_-]?token|refresh[_-]?token|session[_-]?(?:id|key|token)|session|sid|auth|csrf|xsrf|csrftoken|jwt|token|jsessionid|asp\.net_sessionid|phpsessid|_m_h5_tk|_tb_token_|x5sec"
BEARER = r"\bbearer\s+[a-z0-9._~+/-]{8,}"
COOKIES = r"\b[a-z0-9_.-]{2,64}=[^;\s]+;\s*[a-z0-9_.-]{2,64}="


def page_state(text: Column) -> Column:
    """Whether a text holds what looks like the state of a signed-in page: credentials by name, bearer tokens, cookies."""
    return F.coalesce(text.rlike(rf"(?i)(?:\b(?:{CREDENTIALS})\b\s*[:=]|{BEARER})|{COOKIES}"), F.lit(False))
