"""Names and texts as column expressions: folding, tokens, parsing, similarity of names."""

from __future__ import annotations

import unicodedata
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CJK = "[一-龥]"
#: Marks of marketing, and invisible, control and private-use characters.
MARKS = "[⚫●◆■▲○☆★™®©Ⓒ]"
INVISIBLE = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\xad\x{200b}-\x{200f}\x{202a}-\x{202e}\x{feff}\x{e000}-\x{f8ff}\x{f0000}-\x{10fffd}]"
#: Words that all mean water, and words that limit a claim.
WATER_NAMES = ["AQUA", "WATER", "EAU"]
HEDGES = "估计|文献|实验|研究|临床"
#: Separators of phrases and of claims.
PHRASE_SPLIT, CLAIM_SPLIT = "[、，,；;\n]", "[。；;！？!?\n]+"


def no_empty(parts: Column) -> Column:
    return F.filter(parts, lambda x: x != "")


def fold(text: Column) -> Column:
    """Lower case, without white space and hyphens: the form that searches compare."""
    return F.regexp_replace(F.lower(text), r"[\s\-]+", "")


def contains_any(text: Column, words: list[str]) -> Column:
    """Whether one of these words stands somewhere in a text; a plain search, much faster than alternatives of a pattern."""
    found = [F.contains(text, F.lit(x)) for x in words]
    return reduce(lambda a, b: a | b, found)


def collapse(text: Column) -> Column:
    """Upper case, letters, digits and Chinese characters only."""
    return F.regexp_replace(F.upper(text), "[^A-Z0-9一-鿿]+", "")


@cache
def _latin_table() -> tuple[str, str]:
    """Latin letters with marks and the letters they stand on, from the Unicode database."""
    pairs = []
    for code in range(0x7F, 0x2100):
        char = chr(code)
        if unicodedata.category(char).startswith("L"):
            plain = "".join(x for x in unicodedata.normalize("NFKD", char) if not unicodedata.combining(x))
            if len(plain) == 1 and plain.isascii():
                pairs.append((char, plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def plain_latin(text: Column) -> Column:
    """Letters with marks become the letters they stand on; other scripts stay."""
    return F.translate(text, *_latin_table())


def normalize_name(name: Column) -> Column:
    """A component's name without noise: marks, invisible characters, other languages' parts, doses, arrows, stars."""
    text = F.regexp_replace(F.coalesce(name, F.lit("")), "[‘’]", "'")
    text = F.regexp_replace(F.regexp_replace(text, INVISIBLE, ""), MARKS, "")
    text = plain_latin(F.regexp_replace(text, "[‐‑]", "-"))
    parts = no_empty(F.transform(F.split(text, r"[\\/]+"), lambda x: F.btrim(x)))
    own = F.coalesce(F.get(F.filter(parts, lambda x: ~F.upper(x).contains("EXTRAIT")), 0), F.get(parts, 0), F.lit(""))
    text = F.when(text.contains("\\") | (F.upper(text).contains("EXTRAIT") & text.contains("/")), own).otherwise(text)
    for pattern in (r"(?i)\s+EXTRAIT\s+.*$", r"\s*\[\s*\]\s*$", r"\s*<\s*\d+(?:\.\d+)?\s*%\s*$", r"\s*->.*$", r"[\s*^]*[*^]+$", r"^[*^\s]+"):
        text = F.regexp_replace(text, pattern, "")
    return F.btrim(F.regexp_replace(text, r"\s+", " "))


def canonical_water(name: Column) -> Column:
    """WATER for names made of words for water only; other names as they are."""
    words = no_empty(F.split(F.upper(name), "[^A-Z]+"))
    only = (F.size(words) > 0) & (F.size(F.array_except(words, F.array(*map(F.lit, WATER_NAMES)))) == 0)
    # most names begin with another word, and need not be split
    return F.when(F.regexp_extract(F.upper(name), "[A-Z]+", 0).isin(WATER_NAMES) & only, F.lit("WATER")).otherwise(name)


def has_cjk(text: Column) -> Column:
    return F.coalesce(text.rlike(CJK), F.lit(False))


def brand_group(brand: Column) -> Column:
    """All Chinese characters of a brand, or the brand if it has none."""
    chinese = F.regexp_replace(F.coalesce(brand, F.lit("")), "[^一-龥]+", "")
    return F.when(chinese != "", chinese).otherwise(F.coalesce(brand, F.lit("")))


def brand_head(brand: Column) -> Column:
    """The first run of Chinese characters of a brand, or the trimmed brand."""
    head = F.regexp_extract(F.coalesce(brand, F.lit("")), f"({CJK}+)", 1)
    return F.when(head != "", head).otherwise(F.btrim(F.coalesce(brand, F.lit(""))))


def title_tokens(title: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(title), F.lit("([a-z0-9]+)"), 1))


def set_jaccard(a: Column, b: Column) -> Column:
    """Shared over all values of two arrays; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def paper_id(url: Column) -> Column:
    """The number after "pubmed" in a link or text; null if there is none."""
    return F.when(contains_any(F.lower(url), ["pubmed", "pmid"]), F.nullif(F.regexp_extract(url, r"(?i)(?:pubmed\.ncbi\.nlm\.nih\.gov/|PMID[:：]?\s*)(\d+)", 1), F.lit("")))


def percent_range(text: Column) -> Column:
    """The least and the greatest of the first two numbers of a percentage; null for formulas and texts without numbers."""
    numbers = F.slice(F.transform(F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)"), 1), lambda x: x.cast("double")), 1, 2)
    found = F.struct(F.array_min(numbers).alias("low"), F.array_max(numbers).alias("high"))
    return F.when(~text.contains("=") & (F.size(numbers) > 0), found)


def effect_phrases(text: Column) -> Column:
    """Short Chinese phrases of a list, each once, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(text, PHRASE_SPLIT), lambda x: F.btrim(x)), lambda x: x.rlike(f"^{CJK}{{2,8}}$")))


def list_tokens(text: Column) -> Column:
    """A comma-separated list, trimmed and lower-cased, in order."""
    return no_empty(F.transform(F.split(F.lower(text), ","), lambda x: F.btrim(x)))


def list_words(text: Column) -> Column:
    """A pasted list of names: commas between digits don't separate; of equal folded names the first stays."""
    parts = no_empty(F.transform(F.split(text, r"(?<!\d)[,，]|[,，](?!\d)|[、;；\n]"), lambda x: F.btrim(x)))
    # names are split and folded once each; a lambda that refers to the folded array would work it out again for each name
    pairs = F.transform(parts, lambda x: F.struct(x.alias("name"), fold(x).alias("folded")))
    none = F.array().cast("array<string>")
    add = lambda so_far, x: F.when(F.array_contains(so_far["seen"], x["folded"]), so_far).otherwise(F.struct(F.array_append(so_far["names"], x["name"]).alias("names"), F.array_append(so_far["seen"], x["folded"]).alias("seen")))
    return F.aggregate(pairs, F.struct(none.alias("names"), none.alias("seen")), add, lambda so_far: so_far["names"])


def stem(text: Column) -> Column:
    """What stands before the first parenthesis."""
    return F.btrim(F.get(F.split(text, "[（(]", 2), 0))


def claims(answer: Column) -> Column:
    """The sentences of an answer that cite something."""
    return F.filter(F.transform(F.split(answer, CLAIM_SPLIT), lambda x: F.btrim(x)), lambda x: x.rlike(r"\[\d{1,3}\]"))


def needs_hedge(sentence: Column) -> Column:
    """Whether a sentence gives a percentage without a word that limits it."""
    return F.contains(sentence, F.lit("%")) & sentence.rlike(r"\d+(?:\.\d+)?\s*%") & ~sentence.rlike(HEDGES)


def citations(text: Column) -> Column:
    """The numbers cited in a text, each once, in order."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d{1,3})\]"), 1), lambda x: x.cast("int"))))


def name_tokens(name: Column) -> Column:
    """Lower-case words of a name without hyphenated page names in parentheses."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(name), r"[（(][a-z0-9]+-[a-z0-9-]*[）)]", " "), F.lit("([a-z0-9]+)"), 1)


def _surplus(a: Column, b: Column) -> Column:
    """The words of `a` beyond their number in `b`, sorted."""
    times = lambda words, word: F.size(F.filter(words, lambda x: x == word))
    kept = F.filter(a, lambda x, i: times(F.slice(a, 1, i + 1), x) > times(b, x))
    return F.array_sort(kept)


def same_name(a: Column, b: Column) -> Column:
    """Whether two names are one name written twice: equal words, repeated words, or at most two words off by two letters."""
    ta, tb = name_tokens(a), name_tokens(b)
    more_a, more_b = _surplus(ta, tb), _surplus(tb, ta)
    repeated = (F.size(F.array_except(more_a, tb)) == 0) & (F.size(F.array_except(more_b, ta)) == 0)
    near = F.forall(F.zip_with(more_a, more_b, lambda x, y: F.levenshtein(x, y)), lambda d: d <= 2)
    return repeated | ((F.size(more_a) == F.size(more_b)) & (F.size(more_a) <= 2) & near)


#: Words of names that stand for mixtures, as parts of a name and as whole words; and single mixtures.
MIXTURE_PARTS = "EXTRACT|FERMENT| OIL|BUTTER|WAX|HYDROLYZED|CROSSPOLYMER"
MIXTURE_NAMES = ["HYALURONIC ACID", "COLLAGEN", "SODIUM HYALURONATE"]
MIXTURE_WORDS = ["EXTRACT", "OIL", "BUTTER", "FERMENT", "COLLAGEN", "HYALURONATE", "HYALURONIC", "POLYSACCHARIDE", "PROTEIN"]
#: What the category of an evaluation says about its evidence.
EVALUATION_TIERS = {"人体功效评价试验": "真人实测", "消费者使用测试": "真人实测", "实验室试验": "实验室试验", "研究数据": "研究数据", "文献资料": "仅文献资料"}


def page_name(shown: Column) -> Column:
    """A component's name as pages show it: no entities, double quotes, invisible spaces and trailing (n %); upper case."""
    text = shown
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", ""), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    text = F.regexp_replace(F.regexp_replace(text, r'["\x{200b}-\x{200d}\x{feff}]', ""), r"\s*\(\s*\d+(?:\.\d+)?\s*%\s*\)\s*$", "")
    return F.upper(F.btrim(F.regexp_replace(text, r"\s+", " ")))


def slash_in_parentheses(name: Column) -> Column:
    """Whether a slash stands inside an open parenthesis or bracket."""
    step = lambda depth, c: F.when(c.isin("(", "["), depth + 1).when(c.isin(")", "]"), F.greatest(depth - 1, F.lit(0))).otherwise(depth)
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("found"))
    walked = F.aggregate(F.split(name, ""), start, lambda a, c: F.struct(step(a["depth"], c).alias("depth"), (a["found"] | ((c == "/") & (a["depth"] > 0))).alias("found")))
    # only names with a slash behind an opening one are walked letter by letter
    return F.when(name.isNull() | name.rlike(r"(?s)[(\[].*/"), walked["found"]).otherwise(F.lit(False))


def plain_number(value: Column) -> Column:
    """A number with up to ten decimals, without trailing zeros and exponents."""
    return F.regexp_replace(F.format_string("%.10f", value), r"\.?0+$", "")


def mixture_part(name: Column) -> Column:
    """Whether a name tells a mixture by one of its parts, or is one that is known."""
    return contains_any(F.upper(name), MIXTURE_PARTS.split("|")) | F.upper(name).isin(MIXTURE_NAMES)


def mixture_word(name: Column) -> Column:
    """Whether a whole word of a name tells a mixture."""
    return contains_any(F.upper(name), MIXTURE_WORDS) & F.arrays_overlap(F.split(F.btrim(F.upper(name)), r"\s+"), F.array(*map(F.lit, MIXTURE_WORDS)))


def evaluation_tier(category: Column) -> Column:
    tiers = F.create_map(*[F.lit(x) for pair in EVALUATION_TIERS.items() for x in pair])
    return F.coalesce(F.element_at(tiers, category), F.lit("研究数据"))


def opinion_sentences(text: Column, most: int = 12) -> Column:
    """Sentences of an opinion's own section (or the whole text) that judge a safety and give a dose or a limit."""
    section = F.regexp_extract(text, r"(?ims)^[ \t]*OPINION[ \t]*$(.*)", 1)
    sentences = F.split(F.when(section != "", section).otherwise(text), r"(?<=[.!?])\s+")
    telling = F.filter(sentences, lambda x: x.rlike("(?i)safe|unsafe|risk") & x.rlike("%|concentration|not considered|cannot"))
    return F.slice(F.transform(telling, lambda x: F.btrim(F.regexp_replace(x, r"\s+", " "))), 1, most)


def snapshot_note(url: Column, title: Column, year_inferred: Column, expired: Column, up: Column, down: Column) -> Column:
    """The note of a price snapshot: its page and title, and what is only estimated; parts that don't hold are left out."""
    return F.concat_ws(
        "；",
        F.concat(F.lit("页面 "), url),
        F.concat(F.lit("标题「"), F.left(F.coalesce(title, F.lit("")), F.lit(80)), F.lit("」")),
        F.when(year_inferred, F.lit("日期仅月日，年份按采集日推断（估计）")),
        F.when(expired, F.lit("好价已过期（促销价有时效）")),
        F.concat(F.lit("值投票 "), up.cast("string"), F.lit(":"), down.cast("string")),
    )


#: Names of alcohols and of acids without dots and white space, and what marks a fragrance.
ALCOHOLS = ["ALCOHOL", "ALCOHOLDENAT", "SDALCOHOL", "ETHANOL", "变性乙醇", "乙醇"]
ACIDS = ["GLYCOLICACID", "SALICYLICACID", "LACTICACID", "MANDELICACID", "AZELAICACID", "MALICACID", "TARTARICACID", "乙醇酸", "水杨酸", "乳酸", "扁桃酸", "杏仁酸", "壬二酸", "苹果酸", "酒石酸"]
FRAGRANCES, FRAGRANCE_CN, PRESERVATIVE = "FRAGRANCE|PARFUM", "香精", "防腐"


def bare_name(name: Column) -> Column:
    """Upper case without dots and white space: the form that the lists of alcohols and acids have."""
    return F.regexp_replace(F.upper(F.coalesce(name, F.lit(""))), r"[.\s]+", "")


def is_alcohol(inci_name: Column, cn_name: Column) -> Column:
    return bare_name(inci_name).isin(ALCOHOLS) | F.coalesce(cn_name.isin(ALCOHOLS), F.lit(False))


def is_acid(inci_name: Column, cn_name: Column) -> Column:
    return bare_name(inci_name).isin(ACIDS) | F.coalesce(cn_name.isin(ACIDS), F.lit(False))


def is_fragrance(inci_name: Column, cn_name: Column) -> Column:
    return contains_any(bare_name(inci_name), FRAGRANCES.split("|")) | F.coalesce(cn_name.contains(FRAGRANCE_CN), F.lit(False))


def component_key(inci_name: Column, cn_name: Column, official: Column) -> Column:
    """What a component is known by across languages: its official Chinese name, a Chinese name of its own, or its upper-case name after INCI:."""
    clean = lambda text: F.btrim(F.regexp_replace(text, r"\s+", " "))
    return F.when(official.isNotNull(), clean(official)).when(has_cjk(cn_name), clean(cn_name)).otherwise(F.concat(F.lit("INCI:"), F.btrim(F.upper(F.coalesce(inci_name, F.lit(""))))))


def official_keys(inci_name: Column) -> Column:
    """Under which names a register may hold a component, best first: as it is, without dots at its end, with one."""
    name = F.btrim(F.upper(F.coalesce(inci_name, F.lit(""))))
    return F.array_distinct(F.array(name, F.regexp_replace(name, r"\.+$", ""), F.concat(name, F.lit("."))))


def same_brand(a: Column, b: Column) -> Column:
    """Whether two brands are equal or one stands in the other; false if one is missing."""
    x, y = F.btrim(a), F.btrim(b)
    return F.coalesce((x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x)), F.lit(False))


def latin_parts(text: Column) -> Column:
    """The parts of a list of components that have a Latin letter."""
    parts = F.transform(F.split(text, "[、，,；;\n]"), lambda x: F.btrim(x))
    return F.filter(parts, lambda x: x.rlike("[A-Za-z]"))


def stated_phrases(text: Column, category: Column, other: str) -> Column:
    """Effect phrases of a text after its category (unless that is `other` once it is canonical), each once, and how many parts were passed over as prose."""
    from evidentia.functions.rules import canonical_family

    parts = no_empty(F.transform(F.split(text, PHRASE_SPLIT), lambda x: F.btrim(x)))
    short = F.filter(parts, lambda x: x.rlike(f"^{CJK}{{2,8}}$"))
    named = F.when(canonical_family(category) != other, F.array(category)).otherwise(F.array().cast("array<string>"))
    return F.struct(F.array_distinct(F.concat(named, short)).alias("phrases"), (F.size(parts) - F.size(short)).alias("skipped"))


def marked_price(text: Column) -> Column:
    """The first number of a price with thousands marks; null if there is none."""
    return F.replace(F.regexp_extract(text, r"(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)", 1), F.lit(","), F.lit("")).try_cast("double")


def join_wrapped(cell: Column) -> Column:
    """A table cell whose lines were wrapped: Chinese lines are joined as they are, a hyphen at a line's end stays, other lines get a space."""
    text = F.regexp_replace(F.btrim(cell), r"[ \t]*\n[ \t]*", "\n")
    text = F.regexp_replace(text, f"(?<={CJK})\n|\n(?={CJK})", "")
    return F.regexp_replace(F.regexp_replace(text, r"(?<=-)\n", ""), r"\n", " ")


def profile_key(text: Column) -> Column:
    """A 32-bit hash of a text: 33 times what was before and the number of its next UTF-16 unit, kept to 32 bits with a sign."""
    return _profile_keys(text)


@F.arrow_udf(T.LongType())
def _profile_keys(texts: pa.Array) -> pa.Array:
    """Each unit counts by the power of 33 of how many follow it; 32-bit numbers wrap by themselves."""
    known = texts.fill_null("").to_pylist()
    units = np.frombuffer("".join(known).encode("utf-16-le"), "<u2").astype(np.uint32)
    sizes = np.array([len(x) if x.isascii() else len(x.encode("utf-16-le")) // 2 for x in known], np.int64)
    ends = np.cumsum(sizes)
    powers = np.cumprod(np.concatenate([[1], np.full(int(sizes.max(initial=0)), 33)]).astype(np.uint32), dtype=np.uint32)
    sums = np.concatenate([[0], np.cumsum(units * powers[np.repeat(ends, sizes) - 1 - np.arange(len(units))], dtype=np.uint32)]).astype(np.uint32)
    found = (sums[ends] - sums[ends - sizes] + np.uint32(5381) * powers[sizes]).astype(np.uint32).view(np.int32)
    return pa.array(found.astype(np.int64), mask=texts.is_null().to_numpy(zero_copy_only=False))


#: Traditional characters and the simplified ones they stand for, as pages of one source show them.
TRADITIONAL, SIMPLIFIED = "維間緊緻豐潤護復顏膚淨潔噴霧華曬專條時麵", "维间紧致丰润护复颜肤净洁喷雾华晒专条时面"
PARENTHESES = r"[（(][^）)]*[）)]"


def name_key(name: Column) -> Column:
    """The form in which names of pages and of a register are compared: simplified characters, plain Latin letters, upper case, no signs."""
    return collapse(plain_latin(F.translate(name, TRADITIONAL, SIMPLIFIED)))


def without_parentheses(name: Column) -> Column:
    return F.regexp_replace(name, PARENTHESES, "")


def in_parentheses(name: Column) -> Column:
    """What stands in each pair of parentheses of a name."""
    return F.transform(F.regexp_extract_all(name, F.lit(f"({PARENTHESES})"), 1), lambda x: F.substring(x, F.lit(2), F.length(x) - 2))


def page_slugs(sitemap: Column, pattern: str, without: str) -> Column:
    """What `pattern` (with one group) finds in the places of a sitemap that don't hold `without`, each once, in order."""
    places = F.regexp_extract_all(sitemap, F.lit(r"(?s)<loc>\s*(.*?)\s*</loc>"), 1)
    kept = F.filter(places, lambda x: ~F.contains(x, F.lit(without)))
    return F.array_distinct(no_empty(F.transform(kept, lambda x: F.regexp_extract(x, pattern, 1))))


def stream_parts(text: Column, field: str) -> Column:
    """A field of each event of a text of server-sent events; the end mark, other lines and broken events are passed over."""
    events = F.filter(F.split(text, r"\n\n+"), lambda x: F.startswith(F.btrim(x), F.lit("data:")))
    bodies = F.transform(events, lambda x: F.btrim(F.substring(F.btrim(x), F.lit(6), F.length(x))))
    return F.array_compact(F.transform(bodies, lambda x: F.when(x != "[DONE]", F.get_json_object(x, f"$.{field}"))))


def answer_field(text: Column, field: str) -> Column:
    """A field of the JSON object that an answer holds between other words; null if it holds none."""
    return F.get_json_object(F.regexp_extract(text, r"(?s)(\{.*\})", 1), f"$.{field}")


def safe_date(text: Column) -> Column:
    """A date in one of three forms (2026-01-31, 2026/1/31, 20260131); null for all others."""
    forms = {r"\d{4}-\d{2}-\d{2}": "yyyy-MM-dd", r"\d{4}/\d{1,2}/\d{1,2}": "yyyy/M/d", r"\d{8}": "yyyyMMdd"}
    return F.coalesce(*[F.when(F.btrim(text).rlike(f"^{pattern}$"), F.try_to_date(F.btrim(text), form)) for pattern, form in forms.items()])
