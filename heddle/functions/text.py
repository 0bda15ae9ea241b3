"""Text functions of the retrieval engine as column expressions (survey rows I1-I9, I17-I30)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Stop words, concepts with their phrases, query framing, code extensions.
STOP_WORDS = (
    "a", "an", "the", "and", "or", "to", "of", "in", "on", "for", "is", "are", "be",
    "with", "this", "that", "how", "what", "from", "by", "as", "it", "at", "into",
    "如何", "怎么", "怎样", "什么", "一下", "一个", "这个", "那个", "可以", "实现", "使用",
)
CONCEPTS = {
    "database-connection": ("数据库连接", "连接数据库", "连数据库", "mysql connection", "database connection", "connect mysql", "jdbc", "datasource", "connection pool", "连接池"),
    "authentication": ("身份验证", "认证", "登录", "鉴权", "authentication", "authorization", "login", "oauth", "jwt", "token validation"),
    "http-api": ("接口请求", "调用接口", "网络请求", "http request", "rest api", "fetch api", "axios", "endpoint", "web service"),
    "error-handling": ("错误处理", "异常处理", "报错", "捕获异常", "error handling", "exception", "try catch", "fallback", "retry", "重试", "接口失败", "请求失败", "超时", "timeout"),
    "configuration": ("配置文件", "环境变量", "应用配置", "configuration", "environment variable", "env var", "settings", "properties file"),
    "file-io": ("读写文件", "文件读取", "文件保存", "file io", "read file", "write file", "filesystem", "input stream", "output stream"),
    "search": ("语义检索", "全文搜索", "查找内容", "semantic search", "full text search", "retrieval", "embedding", "vector search"),
    "concurrency": ("并发", "异步", "多线程", "协程", "concurrency", "async", "await", "thread pool", "parallel"),
    "testing": ("单元测试", "自动化测试", "测试用例", "unit test", "integration test", "test case", "assertion", "mock"),
    "logging": ("日志记录", "日志输出", "排查日志", "logging", "logger", "log output", "observability", "trace"),
    "cache": ("缓存", "缓存失效", "cache", "redis", "memoization", "ttl"),
    "deployment": ("部署", "发布上线", "容器化", "deployment", "docker", "container", "kubernetes", "ci cd"),
    "data-format": ("解析 json", "序列化", "数据格式", "parse json", "serialization", "deserialize", "yaml", "csv"),
    "dependency": ("安装依赖", "包管理", "依赖冲突", "dependency", "package manager", "npm install", "maven", "pip install"),
}
CODE_INTENT = "(?i)(代码|源码|实现|定义|类|方法|函数|接口|调用链|code|source|implementation|defined|definition|class|method|function)"
LOCATION_INTENT = "(?i)(在哪|哪里|哪儿|位置|哪个文件|什么文件|怎么找到|帮我找|定位|where|which file|location|find|located)"
FRAMING = (
    "(?i)(请帮我找|帮我找|请问|请帮我|帮我|告诉我|我想知道|具体的?|在哪(里|儿)?|哪个文件|什么文件|怎么找到"
    "|where\\s+(is|are|can\\s+i\\s+find)|which\\s+file|location\\s+of"
    "|find\\s+(the\\s+)?(code|implementation)|source\\s+code)"
)
TRAILING_NOISE = "(相关|对应|这个|那个|该)\\s*(的)?\\s*(代码|源码|实现|定义|位置|文件)|\\s*(代码|源码|实现|定义|位置)\\s*$"
SCORED_CODE_EXTENSIONS = (
    "java", "kt", "kts", "py", "js", "jsx", "ts", "tsx", "go", "rs", "c", "h",
    "cpp", "hpp", "cs", "php", "rb", "swift", "scala", "sql", "sh", "bash", "ps1",
    "bat", "cmd", "css", "scss", "vue", "svelte",
)
CHUNKED_CODE_EXTENSIONS = SCORED_CODE_EXTENSIONS + (
    "lua", "r", "pl", "pm", "ex", "exs", "erl", "dart", "groovy",
    "proto", "graphql", "gql", "tf", "tfvars", "hcl",
)

SENSITIVE_NAMES = ("key", "authorization", "prompt", "content", "chunktext", "body")  # parts of attribute names

CONCEPT_WEIGHT, QUERY_CONCEPT_WEIGHT = 2.8, 4.0
HAN_TOKEN, HAN_GRAM, LATIN = 1.0, 0.9, 1.0
QUERY_HAN_TOKEN, QUERY_HAN_GRAM, QUERY_LATIN = 1.4, 1.25, 1.25
WHOLE, GRAM, CONCEPT = "\x01", "\x02", "concept:"  # marks of tokens on their way
#: What may change under compatibility normalisation. The rest are letters and signs that it leaves as they are, whatever stands beside them.
CHANGING = r"[^\x00-\x7F](?<![\u00A1-\u00A7\u00A9\u00AB-\u00AE\u00B0\u00B1\u00B6\u00B7\u00BB\u00BF-\u0131\u0134-\u013E\u0141-\u0148\u014A-\u017E\u2012-\u2016\u2018-\u2023\u20AC])"
WIDE = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.str.normalize("NFKC")


def nfkc(text: Column) -> Column:
    """Compatibility normalisation (full-width letters, ligatures, ...). Spark has no built-in for it; texts that it can't change don't leave the JVM. Give it a column of its own: it is looked at twice."""
    return F.coalesce(_nfkc(F.when(text.rlike(CHANGING), text)), text)


def normalise(text: Column) -> Column:
    """Compatibility characters replaced, lower case, forward slashes."""
    return F.replace(F.lower(nfkc(text)), F.lit("\\"), F.lit("/"))


def split_camel(text: Column) -> Column:
    """A space between the words of a camel-case name. Two steps, as the oracle's regular expressions know no lookaround."""
    return F.regexp_replace(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z])([A-Z][a-z])", "$1 $2")


def han_tokens(normal: Column) -> Column:
    """The tokens of the Han runs: short runs whole, marked by WHOLE, and all 2- and 3-grams, marked by GRAM."""
    runs = F.regexp_extract_all(normal, F.lit(r"(\p{IsHan}+)"), 1)

    def grams(t: Column, n: int) -> Column:
        starts = F.when(F.length(t) >= n, F.sequence(F.lit(1), F.length(t) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat(F.lit(GRAM), F.substring(t, i, F.lit(n))))

    short = F.transform(F.filter(runs, lambda t: F.length(t) <= 5), lambda t: F.concat(F.lit(WHOLE), t))
    return F.concat(short, F.flatten(F.transform(runs, lambda t: F.concat(grams(t, 2), grams(t, 3)))))


def concepts(compact: Column) -> Column:
    """Names of the concepts of which a phrase stands in the normal text without its white space. Give it a column of its own: it is looked at for each phrase."""
    found = []
    for name, phrases in CONCEPTS.items():
        hit = F.lit(False)
        for phrase in phrases:
            hit = hit | F.contains(compact, F.lit(phrase.replace(" ", "")))
        found.append(F.when(hit, F.lit(name)))
    return F.array_compact(F.array(*found))


def han_of(text: Column) -> Column:
    """The tokens of a text's Han runs; most texts hold no letter from U+2E80 on, so none of Han, and aren't looked at further."""
    normal = normalise(split_camel(F.when(text.rlike(r"[^\x00-\u2E7F]"), text)))
    return F.coalesce(han_tokens(normal), F.array().cast("array<string>"))


def token_lists(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """(keys, tokens): each text's tokens as they come, as strings whose form tells their weight: words and Han grams, and concepts of which a phrase stands in it."""
    rows = df.select(*keys, normalise(split_camel(text)).alias("_normal"))
    rows = rows.withColumn("_compact", F.regexp_replace("_normal", r"\s+", ""))
    none = F.array().cast("array<string>")
    words = F.regexp_extract_all("_normal", F.lit("([a-z0-9]+)"), 1)
    han = F.when(F.col("_normal").rlike(r"\p{IsHan}"), han_tokens(F.col("_normal"))).otherwise(none)
    tags = F.transform(concepts(F.col("_compact")), lambda c: F.concat(F.lit(CONCEPT), c))
    return rows.select(*keys, F.concat(words, han, tags).alias("tokens"))


def token_rows(df: DataFrame, key: str, text: Column, query: bool = False) -> DataFrame:
    """(key, token, weight): the added weights of each token of a text."""
    # outer: for a plain explode Spark would add a filter on the array and push it below the steps that make it
    each = token_lists(df, [key], text).select(key, F.explode_outer("tokens").alias("t"))
    marked = F.col("t") < "0"  # of the marks and letters that a token begins with, the marks come first
    token = F.when(marked, F.expr("substring(t, 2)")).otherwise(F.col("t"))
    whole, gram, latin, concept = (QUERY_HAN_TOKEN, QUERY_HAN_GRAM, QUERY_LATIN, QUERY_CONCEPT_WEIGHT) if query else (HAN_TOKEN, HAN_GRAM, LATIN, CONCEPT_WEIGHT)
    weight = F.when(F.startswith("t", F.lit(CONCEPT)), concept).when(~marked, latin).when(F.startswith("t", F.lit(WHOLE)), whole).otherwise(gram)
    each = each.where(F.length("t") > 1).select(key, token.alias("token"), weight.alias("weight")).where((F.length("token") > 1) & ~F.col("token").isin(*STOP_WORDS))
    return each.groupBy(key, "token").agg(F.sum("weight").alias("weight"))


def query_subject(query: Column) -> Column:
    """A query without its conversational framing; the query itself if nothing would be left."""
    cleaned = strip(F.coalesce(query, F.lit("")))
    subject = F.regexp_replace(F.regexp_replace(F.regexp_replace(cleaned, FRAMING, " "), "[？?，,：:]+", " "), r"\s+", " ")
    subject = strip(F.regexp_replace(F.regexp_replace(strip(subject), TRAILING_NOISE, " "), r"\s+", " "))
    return F.when(subject == "", cleaned).otherwise(subject)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def code_intent(query: Column) -> Column:
    return F.coalesce(query, F.lit("")).rlike(CODE_INTENT)


def location_intent(query: Column) -> Column:
    return F.coalesce(query, F.lit("")).rlike(LOCATION_INTENT)


def unit_tokens(text: Column) -> Column:
    """Estimated tokens of a line: wide characters, and a quarter of the others, rounded up; one at least."""
    wide = F.length(F.regexp_replace(text, r"[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]", ""))
    return F.greatest(F.lit(1), wide + F.ceil((F.length(text) - wide) / 4).cast("int"))


def message_tokens(text: Column, factor: Column | float = 1.0) -> Column:
    """Estimated tokens of a chat message: nothing for an empty one, else the rounded-up estimate and 4 for the frame, times a calibration factor."""
    text = F.coalesce(text, F.lit(""))
    wide = F.length(F.regexp_replace(text, r"[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]", ""))
    plain = F.ceil(wide + (F.length(text) - wide) / 4)
    return F.ceil((plain + 4) * factor).cast("long")


def extension(path: Column) -> Column:
    """Lower-case text after the last dot of the file name, else `text`."""
    found = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(found == "", F.lit("text")).otherwise(found)


def redact(text: Column) -> Column:
    """Bearer tokens and keys blanked; 500 characters at most."""
    text = F.regexp_replace(text, r"(?i)(bearer\s+)[A-Za-z0-9._~+/=-]+", "$1[REDACTED]")
    text = F.regexp_replace(text, r"(?i)((?:api[_-]?key|token|secret|password)\s*[=:]\s*\"?)[^\s,;\"]+", "$1[REDACTED]")
    return F.substring(text, 1, 500)


def snippet(text: Column, limit: int = 180) -> Column:
    """White space collapsed; longer texts end in three dots."""
    flat = strip(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 3), F.lit("..."))).otherwise(flat)


def digest_prompt(text: Column, limit: int = 320) -> Column:
    """White space collapsed; longer texts are cut and end in a space and an ellipsis."""
    flat = strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit(" …"))).otherwise(flat)


def cut_passage(text: Column, limit: int = 1600) -> Column:
    """Longer texts are cut, and say so in a line of their own."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("\n...[chunk truncated]"))).otherwise(text)


def redact_attributes(attributes: Column) -> Column:
    """A map of texts without the values of sensitive names, and without keys in the others; null values are empty."""
    sensitive = lambda name: F.lower(name).rlike("|".join(SENSITIVE_NAMES))
    return F.transform_values(attributes, lambda name, value: F.when(sensitive(name), "[REDACTED]").otherwise(redact(F.coalesce(value, F.lit("")))))


def host_of(url: Column) -> Column:
    """Lower-case host[:port] of an http(s) address without user info, else null."""
    return F.nullif(F.lower(F.regexp_extract(url, r"(?i)^https?://([^/?#@\s]+)(?:[/?#]|$)", 1)), F.lit(""))


def query_terms(query: Column) -> Column:
    """Distinct words of a query for literal highlighting."""
    return F.array_distinct(F.regexp_extract_all(F.lower(query), F.lit(r"([\p{L}\p{N}_-]{2,})"), 1))
