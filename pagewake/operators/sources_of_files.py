"""Classes of the pages that files were found on, by the words of their URL, title and excerpt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewake.functions import urls
from pagewake.operators.sections import GENERAL, holds

# Category, its words, least files for the first of two levels, importance, conversion.
IN_URL_OR_TITLE = (
    ("exam_education", ("exam-req", "/education/exam", "/exam", "exams-admissions", "exam ", "exam-", "syllabus", "study materials", "credential", "pass marks", "asa-req", "asa pathway", "vee", "admissions"), 0, ("low", "low"), ("skip", "skip")),
    ("governance_management", ("governance", "board", "leadership", "election", "elections", "bylaws", "policy", "policies", "guideline", "guidelines", "statute", "professionalism", "annual-report", "annual reports", "annual report", "council", "committee-meetings"), 0, ("low", "low"), ("skip", "skip")),
    ("finance_reports", ("finances", "financial", "budget", "budgets", "statement", "statements", "audited", "audit", "accounting"), 0, ("high", "high"), ("high", "high")),
    ("research_publications", ("research", "publication", "publications", "journal", "paper series", "white paper", "monograph", "working paper", "actuarial-review"), 3, ("high", "medium"), ("high", "medium")),
    ("membership_operations", ("membership", "member", "dues", "sponsorship", "advertising", "partners", "directory", "contact"), 2, ("medium", "low"), ("medium", "low")),
    ("news_announcements", ("news", "announcement", "press", "call for nominations"), 0, ("medium", "medium"), ("low", "low")),
)
IN_EXCERPT = (
    ("research_publications", ("research", "paper", "publication", "journal", "white paper"), 0, ("medium", "medium"), ("medium", "medium")),
    ("archive_reference", ("archive", "historical", "1998", "1999", "2000", "2001", "2002"), 0, ("low", "low"), ("skip", "skip")),
)


def classify(pages: DataFrame, url: str, title: str, excerpt: str, files: str) -> DataFrame:
    """pages with source_category, business_importance and conversion_priority; the first class whose words occur."""
    head = F.lower(F.concat_ws(" ", urls.path_of(F.col(url)), F.col(title)))
    body = F.lower(F.coalesce(F.col(excerpt), F.lit("")))
    made: dict[str, Column] = {"source_category": F.lit(GENERAL), "business_importance": F.lit("medium"), "conversion_priority": F.lit("medium")}
    for text, table in ((body, IN_EXCERPT), (head, IN_URL_OR_TITLE)):
        for name, words, least, importance, conversion in reversed(table):
            here, many = holds(text, words), F.col(files) >= least
            for column, value in (("source_category", F.lit(name)), ("business_importance", F.when(many, importance[0]).otherwise(importance[1])), ("conversion_priority", F.when(many, conversion[0]).otherwise(conversion[1]))):
                made[column] = F.when(here, value).otherwise(made[column])
    return pages.withColumns(made)
