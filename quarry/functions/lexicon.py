"""Entity tags and query expansion from a dictionary of names and aliases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import HAN

# Canonical names, aliases of names, drug-form endings, limits.
ALIASES = {
    "高血压": ["高血压病", "原发性高血压"],
    "高血压急症": ["高血压危象", "高血压危症"],
    "心力衰竭": ["心衰", "慢性心衰", "CHF"],
    "心肌梗死": ["心梗", "急性心梗", "AMI", "STEMI"],
    "脑梗死": ["脑梗", "缺血性卒中", "脑梗塞"],
    "糖尿病": ["DM", "2型糖尿病", "T2DM"],
    "冠心病": ["冠状动脉粥样硬化性心脏病", "CHD"],
    "慢性阻塞性肺疾病": ["COPD", "慢阻肺"],
    "硝苯地平": ["硝苯地平控释片", "硝苯啶"],
    "阿司匹林": ["乙酰水杨酸", "ASA"],
    "氯吡格雷": ["波立维"],
    "呋塞米": ["速尿", "呋喃苯胺酸"],
    "螺内酯": ["安体舒通"],
    "收缩压": ["SBP", "高压"],
    "舒张压": ["DBP", "低压"],
}
CANONICAL = [
    "高血压急症", "高血压", "心力衰竭", "心肌梗死", "脑梗死", "糖尿病", "冠心病",
    "慢性阻塞性肺疾病", "肺炎", "哮喘", "肾功能不全", "高钾血症", "低钾血症",
    "硝苯地平", "阿司匹林", "氯吡格雷", "呋塞米", "螺内酯", "美托洛尔", "氨氯地平",
    "培哚普利", "缬沙坦", "厄贝沙坦", "氢氯噻嗪", "硝酸甘油", "硝普钠",
    "收缩压", "舒张压", "靶器官损害", "静脉降压", "血钾", "肌酐",
    "心电图", "CT", "MRI", "超声心动图",
]
DRUG_FORM = rf"[{HAN}]{{2,6}}(?:片|胶囊|注射液|缓释片|控释片)"
MOST_TAGS, MOST_TERMS = 16, 8


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in values])


def tag(text: Column) -> Column:
    """array<string>: canonical names in the text, longest first, then names of which an
    alias occurs, then drug forms; distinct, at most 16.  Matching is of substrings
    and case-sensitive; blank texts have no tags."""
    t = F.coalesce(text, F.lit(""))
    named = F.filter(_strings(sorted(CANONICAL, key=len, reverse=True)), lambda x: F.contains(t, x))
    known = F.array(*[F.struct(F.lit(c).alias("name"), _strings(a).alias("aliases")) for c, a in ALIASES.items()])
    aliased = F.transform(F.filter(known, lambda e: F.exists(e["aliases"], lambda a: F.contains(t, a))), lambda e: e["name"])
    drugs = F.filter(F.regexp_extract_all(t, F.lit(DRUG_FORM), F.lit(0)), lambda x: F.length(x).between(3, 10))
    return F.slice(F.array_distinct(F.concat(named, aliased, drugs)), 1, MOST_TAGS)


def _expansions() -> dict[str, list[str]]:
    """Tag -> what it adds: its aliases, and the names that have it as alias, with theirs."""
    out: dict[str, list[str]] = {name: list(aliases) for name, aliases in ALIASES.items()}
    for name, aliases in ALIASES.items():
        for alias in aliases:
            out.setdefault(alias, []).extend([name, *aliases])
    return out


def expand_query(query: Column) -> Column:
    """The query, a space, and up to 8 related terms that it doesn't contain."""
    added = F.create_map(*[x for k, v in _expansions().items() for x in (F.lit(k), _strings(v))])
    none = F.array().cast("array<string>")
    terms = F.flatten(F.transform(tag(query), lambda t: F.concat(F.array(t), F.coalesce(F.try_element_at(added, t), none))))
    fresh = F.slice(F.filter(F.array_distinct(terms), lambda t: (F.length(t) > 0) & ~F.contains(query, t)), 1, MOST_TERMS)
    return F.when(F.size(fresh) > 0, F.concat(query, F.lit(" "), F.array_join(fresh, " "))).otherwise(query)
