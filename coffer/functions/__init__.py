"""Column-to-column functions built only from Spark expressions."""

from .fiscal import biennium_start, fiscal_year_of, income_tax, is_close
from .fund import (
    county_fund_category,
    fund_from_text,
    fund_group,
    fund_name,
    fund_suffix,
    repair_fund_code,
)
from .money import clean_money, currency_label, parse_money
from .text import (
    department_slug,
    expand_project_name,
    join_sentences,
    normalize_markdown,
    normalize_name,
    possessive_title,
    pretty_name,
    slug,
    title_small_words,
    truncate_label,
)

__all__ = [name for name in dir() if not name.startswith("_")]
