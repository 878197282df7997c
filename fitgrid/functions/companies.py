"""Company names, role words and employment wording."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _nfkc(batch: pd.Series) -> pd.Series:
    """Compatibility normal form; Spark has no expression for it. Use it once per stored name.

    Filters on the result stay above it and names folded side by side share one
    call, so a task runs one Python worker for it and not one per use.
    """
    return batch.map(lambda t: unicodedata.normalize("NFKC", t) if isinstance(t, str) else t)


# the result is the same every time; the mark only keeps the optimizer from repeating the call
nfkc = F.pandas_udf(_nfkc, StringType()).asNondeterministic()


# Legal forms and punctuation that do not tell companies apart.
LEGAL_FORMS = (
    r"株式会社|有限会社|合同会社|一般社団法人|（株）|\(株\)|㈱|inc\.?|co\.,?\s*ltd\.?|ltd\.?|corporation|"
    r"corp\.?|llc|k\.k\.")
_PUNCTUATION = r"[\s　 ・.,、。'\"’()（）-]+"


def bare_company(folded: Column) -> Column:
    """Folded company name without legal form and punctuation."""
    plain = F.lower(folded)
    return F.regexp_replace(F.regexp_replace(plain, f"(?iu){LEGAL_FORMS}", ""), _PUNCTUATION, "")


def same_company(a: Column, b: Column) -> Column:
    """Whether one bare name contains the other; empty names match nothing."""
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def role_terms(folded: Column) -> Column:
    words = F.split(F.lower(F.coalesce(folded, F.lit(""))), r"[\s　 、,，・/／()（）]+")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


# How titles word an employment type, and the declared types that fit it.
EMPLOYMENT_WORDS = {
    "full_time": r"正社員|中途|full.?time",
    "part_time": r"パート|アルバイト|part.?time",
    "contract": r"契約|業務委託|派遣|contract",
    "intern": r"インターン|intern",
    "new_grad": r"新卒|新卒採用|new.?grad|graduate",
}
EMPLOYMENT_DECLARED = {
    "full_time": ("FULL_TIME",), "part_time": ("PART_TIME",),
    "contract": ("CONTRACTOR", "TEMPORARY"), "intern": ("INTERN",), "new_grad": (),
}


def employment_fit(wanted: Column, declared: Column, title: Column) -> Column:
    """true / false when the posting states it, null when it does not say."""
    words = {kind: title.rlike(f"(?iu){pattern}") for kind, pattern in EMPLOYMENT_WORDS.items()}
    answer = F.lit(None).cast("boolean")
    for kind, types in EMPLOYMENT_DECLARED.items():
        own = words[kind]
        others = None
        for other, found in words.items():
            if other != kind:
                others = found if others is None else others | found
        by_title = F.when(own, True).when(others, False)
        fits = by_title
        if types:
            listed = F.array(*[F.lit(t) for t in types])
            fits = F.when(F.size(declared) > 0, F.arrays_overlap(declared, listed)).otherwise(by_title)
        answer = F.when(wanted == kind, fits).otherwise(answer)
    return answer
