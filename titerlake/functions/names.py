"""Standard names of methods, antibodies, provinces and groups of people; diseases come with a table of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titerlake.functions.parsing import alias_by_first, alias_by_longest

#: Aliases of detection methods with their standard name, in the order in which they are tried (fixed values).
METHODS = {
    "elisa": "ELISA", "ELISA": "ELISA", "酶联免疫吸附试验": "ELISA", "酶联免疫吸附实验": "ELISA", "酶联免疫": "ELISA", "酶联": "ELISA",
    "clia": "CLIA", "CLIA": "CLIA", "化学发光免疫分析": "CLIA", "化学发光免疫分析法": "CLIA", "化学发光": "CLIA", "化学发光法": "CLIA",
    "ifa": "IFA", "IFA": "IFA", "间接免疫荧光": "IFA", "间接免疫荧光法": "IFA",
    "nt": "NT", "NT": "NT", "中和试验": "NT", "中和实验": "NT", "中和抗体试验": "NT",
    "hai": "HAI", "HAI": "HAI", "血凝抑制试验": "HAI", "血凝抑制实验": "HAI", "血凝抑制": "HAI",
    "wb": "WB", "WB": "WB", "免疫印迹": "WB", "免疫印迹法": "WB", "western blot": "WB",
    "ria": "RIA", "RIA": "RIA", "放射免疫分析": "RIA", "放射免疫": "RIA",
    "lfa": "LFA", "LFA": "LFA", "侧流免疫层析": "LFA", "侧流免疫": "LFA", "胶体金": "LFA",
    "multiplex": "Multiplex", "Multiplex": "Multiplex", "多重微珠免疫分析": "Multiplex", "多重微珠": "Multiplex",
    "pcr": "PCR", "PCR": "PCR", "rt-pcr": "RT-PCR", "RT-PCR": "RT-PCR",
}
#: Aliases of antibody types, likewise (fixed values).
ANTIBODIES = {
    "igg": "IgG", "IgG": "IgG", "IGG": "IgG", "immunoglobulin g": "IgG", "Immunoglobulin G": "IgG",
    "igm": "IgM", "IgM": "IgM", "IGM": "IgM", "immunoglobulin m": "IgM", "Immunoglobulin M": "IgM",
    "iga": "IgA", "IgA": "IgA", "IGA": "IgA", "immunoglobulin a": "IgA", "Immunoglobulin A": "IgA",
    "ige": "IgE", "IgE": "IgE", "IGE": "IgE", "总抗体": "Total Ab", "total antibody": "Total Ab", "中和抗体": "Neutralizing Ab", "neutralizing": "Neutralizing Ab",
}
#: Provinces with their English name and what their full name adds (fixed values).
_PROVINCES = (
    ("北京", "市", "Beijing"), ("天津", "市", "Tianjin"), ("上海", "市", "Shanghai"), ("重庆", "市", "Chongqing"), ("河北", "省", "Hebei"), ("山西", "省", "Shanxi"), ("内蒙古", "自治区", "Inner Mongolia"),
    ("辽宁", "省", "Liaoning"), ("吉林", "省", "Jilin"), ("黑龙江", "省", "Heilongjiang"), ("江苏", "省", "Jiangsu"), ("浙江", "省", "Zhejiang"), ("安徽", "省", "Anhui"), ("福建", "省", "Fujian"),
    ("江西", "省", "Jiangxi"), ("山东", "省", "Shandong"), ("河南", "省", "Henan"), ("湖北", "省", "Hubei"), ("湖南", "省", "Hunan"), ("广东", "省", "Guangdong"), ("广西", "壮族自治区", "Guangxi"),
    ("海南", "省", "Hainan"), ("四川", "省", "Sichuan"), ("贵州", "省", "Guizhou"), ("云南", "省", "Yunnan"), ("西藏", "自治区", "Tibet"), ("陕西", "省", "Shaanxi"), ("甘肃", "省", "Gansu"),
    ("青海", "省", "Qinghai"), ("宁夏", "回族自治区", "Ningxia"), ("新疆", "维吾尔自治区", "Xinjiang"), ("台湾", "省", "Taiwan"), ("香港", "特别行政区", "Hong Kong"), ("澳门", "特别行政区", "Macau"),
)
#: Names of one character, after all others (fixed values).
_SHORT = (
    "京北京 津天津 沪上海 渝重庆 冀河北 晋山西 蒙内蒙古 辽辽宁 吉吉林 黑黑龙江 苏江苏 浙浙江 皖安徽 闽福建 赣江西 鲁山东 豫河南 鄂湖北 湘湖南 粤广东 桂广西 琼海南 川四川 蜀四川 "
    "黔贵州 贵贵州 滇云南 云云南 藏西藏 陕陕西 秦陕西 甘甘肃 陇甘肃 青青海 宁宁夏 新新疆 台台湾 港香港 澳澳门"
)
PROVINCES = {alias: name for name, more, english in _PROVINCES for alias in (name, name + more, english)} | {s[0]: s[1:] for s in _SHORT.split()}
#: Endings that are taken off a name that no alias fits (fixed values).
_ENDINGS = ("省", "市", "自治区", "特别行政区")


def standard_disease(name: Column, aliases: dict[str, str]) -> Column:
    """By the caller's table of aliases: exact, in any case, or the longest alias held by the name; others stay."""
    return alias_by_longest(name, aliases)


def disease_aliases(table: DataFrame, most: int = 5000) -> dict[str, str]:
    """The table ``alias, name`` of a file as a dictionary, in the order of ``position``; a dictionary of names, so small, and checked to be."""
    rows = table.orderBy("position").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} aliases")
    return {r["alias"]: r["name"] for r in rows}


def standard_method(name: Column) -> Column:
    return alias_by_first(name, METHODS, fold=True)


def standard_antibody(name: Column) -> Column:
    return alias_by_first(name, ANTIBODIES, fold=True)


def standard_province(name: Column) -> Column:
    """Exact, else the first alias that holds the name or is held by it (names of one character too), then the same without endings."""
    found = alias_by_first(name, PROVINCES)
    bare = F.trim(name)
    for ending in _ENDINGS:
        bare = F.replace(bare, F.lit(ending), F.lit(""))
    again = F.when(F.length(F.trim(bare)) > 0, alias_by_first(bare, PROVINCES))
    known = F.array(*[F.lit(p) for p, *_ in _PROVINCES])
    return F.when(F.array_contains(known, found), found).when(F.array_contains(known, again), again).otherwise(found)


def standard_group(name: Column, aliases: dict[str, str], by_age: tuple[str, str, str] = ("儿童", "老年人", "成人")) -> Column:
    """Group of people by the caller's aliases (two characters or more also by containment), then by an age that the name begins with.

    ``by_age`` names children, old people and adults. A range of years is children, one age what the name says.
    """
    child, old, adult = by_age
    n = F.trim(name)
    unknown = alias_by_first(F.when(F.length(n) > 0, n), {k: v for k, v in aliases.items() if len(k) >= 2})
    exact = F.try_element_at(F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]), n)
    span, one = n.rlike(r"^\d+[-~]\d+岁"), n.rlike("^(≥|>=|>)?\\d+岁(以上|以下)?(成人|儿童|老年人)?$")
    aged = F.when(n.rlike("老年|60|65"), old).when(n.rlike("儿童|幼儿"), child).when(n.rlike("成人|成年"), adult).otherwise(child)
    return F.when(F.length(name) > 0, F.coalesce(exact, F.when(unknown != n, unknown), F.when(span, F.lit(child)).when(one, aged), n))
