"""Wording of results for readers.  Operators give ids, `id` or `id=value`; only here do they become sentences.

A caller may hand in another table, in any language, with the same ids.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TEXTS = {
    # what scores and findings rest on
    "no_title": "the page has no title", "no_h1": "there is no main heading", "noindex": "search engines are told to leave the page out",
    "canonical_elsewhere": "the canonical address is on another host", "no_meta_description": "there is no description for result lists",
    "no_schema": "no structured data was found", "images_without_alt": "{} images lack an alternative text",
    "no_og_title": "there is no title for shared links", "keyword_not_in_title": "the title leaves the keyword out",
    "keyword_not_in_h1": "the main heading leaves the keyword out", "under_300_words": "the text has fewer than 300 words",
    "words": "the text has {} words", "rival_words": "rivals have {} words on average", "no_table": "the text has no table",
    "no_faq": "questions and answers are missing", "few_h2": "there are fewer than three sections", "h2s": "sections: {}",
    "no_rivals": "no rival page was given", "rivals_have_faq": "rivals answer questions and this page does not",
    "rivals_with_faq": "rivals with questions and answers: {}", "rivals_have_tables": "rivals show tables and this page does not",
    "no_author": "no author is named", "no_date": "no date is given", "no_official_source": "no official source is linked",
    "overclaims": "promises too much: {}", "no_internal_links": "nothing links to other pages of the site",
    "internal_links": "links to the own site: {}", "weak_anchors": "several links say nothing about their target",
    "title_chars": "the title has {} characters", "short_title": "the title is short", "long_meta_description": "the description is too long to be shown whole",
    "few_questions": "fewer than two questions are asked", "no_early_answer": "the beginning answers no question",
    "old_years": "past years are named: {}", "no_cta": "readers are not told what to do next",
    "service_without_contact": "a service is offered without a way to reach it", "needs_sitemap": "needs the other pages of the site",
    "needs_site_analysis": "needs the whole site", "keyword": "keyword: {}", "title": "title: {}",
    # what can be read from an article, and what may go wrong with it
    "faq": "questions and answers", "tables": "tables: {}", "visa_rules_change": "rules of entry change; say when they were checked",
    "cta_phrases": "no phrase invites an action", "service_contact": "a service without phone, mail or booking",
    # rivals
    "unfetched": "the rival's page could not be read", "longer": "longer text ({} words)", "has_faq": "answers questions",
    "has_tables": "shows tables", "more_official": "links more official sources", "more_h2s": "more sections ({})",
    "missing_words": "about {} words are missing", "more_sources": "link official sources", "more_sections": "cover more sections",
    # mends, by rule of a failure
    "fix_title": "write a title of at most 60 characters that names the keyword", "fix_h1": "give the page one main heading",
    "fix_thin": "say more that helps the reader", "fix_faq": "answer the usual questions", "fix_links": "link related pages",
    "fix_author": "name the author", "fix_date": "show when the text was written and checked", "fix_sources": "link the authority in charge",
    "fix_overclaim": "promise nothing that cannot be kept", "fix_meta": "describe the page in up to 160 characters",
    "fix_keyword": "name the keyword in the title: {}", "fix_tables": "sum up papers, fees or dates in a table",
    "fix_structure": "divide the text into sections", "fix_competitor_faq": "answer the questions that rivals answer",
    "fix_competitor_depth": "add about {} words",
    # actions for keywords and rivals
    "create": "write a page for it", "protect": "keep the place", "improve": "lead readers there and on", "refresh": "renew the page",
    "support": "strengthen the page with links", "fill_gaps": "write for the missing keywords", "watch": "keep watching",
}


def sentence(item: Column, texts: dict[str, str] = TEXTS) -> Column:
    """The wording of `id` or `id=value`; an unknown id stays as it is."""
    table = F.create_map(*[F.lit(x) for pair in texts.items() for x in pair])
    name, value = F.substring_index(item, "=", 1), F.regexp_extract(item, r"(?s)^[^=]*=(.*)$", 1)
    return F.coalesce(F.replace(F.try_element_at(table, name), F.lit("{}"), value), item)


def sentences(items: Column, texts: dict[str, str] = TEXTS) -> Column:
    return F.transform(items, lambda x: sentence(x, texts))
