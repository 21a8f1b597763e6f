"""Which files of a tree are read, and what has changed since the last run."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weft.operators.merge import manifest_diff
from weft.plans.runtime import ship

#: Part of every content hash, so that a new reader makes all files new.
VERSION = "weft-1"
MAX_TEXT, MAX_ANY = 10 << 20, 50 << 20
#: Kinds by extension.
KINDS = {
    "document": ("md", "markdown", "mdx", "rst", "txt", "html", "htm", "docx", "xlsx", "csv"),
    "paper": ("pdf",),
    "image": ("png", "jpg", "jpeg", "webp", "gif", "svg"),
    "video": ("mp4", "mov", "mkv", "webm", "avi"),
    "audio": ("mp3", "wav", "m4a", "ogg", "flac"),
}
#: Folders of other people's or of generated files, and names that may hold secrets.
NOISE = "node_modules|target|dist|build|vendor|__pycache__|venv|coverage|out"
ALLOWED_HIDDEN = "github|gitlab|circleci|config|husky"
SENSITIVE = r"(?i)(^|/)(\.env(\..*)?|\.netrc|\.npmrc|\.pypirc|id_(rsa|dsa|ecdsa|ed25519)|credentials(\..*)?|secrets?(\..*)?)$|\.(pem|key|p12|pfx|keystore|jks)$"
MINIFIED = r"(?i)[.-]min\.(js|css)$"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([A-Za-z0-9]+)$", 1))


def file_kind(path: Column, first_line: Column | None = None) -> Column:
    """code, document, paper, image, video, audio, or null where nothing is known; a manifest is code."""
    from weft.sources.code import EXTENSIONS, MANIFESTS

    ext, name = extension(path), F.element_at(F.split(path, "/"), -1)
    code = sorted(e for e, language in EXTENSIONS.items() if language not in ("markdown", "rst", "text", "html"))
    chain = F.when(name.isin(*MANIFESTS), "code").when(path.rlike(MINIFIED), F.lit(None).cast("string")).when(ext.isin(*code), "code")
    for kind, extensions in KINDS.items():
        chain = chain.when(ext.isin(*extensions), kind)
    if first_line is not None:
        chain = chain.when((ext == "") & first_line.rlike(r"^#!.*\b(python|bash|sh|zsh|node|deno|ruby|perl|php|lua)[\d.]*\b"), "code")
    return chain


def is_noise(path: Column) -> Column:
    return path.rlike(rf"(^|/)({NOISE})/") | path.rlike(rf"(^|/)\.(?!({ALLOWED_HIDDEN})/)[^/]+/")


def looks_minified(text: Column) -> Column:
    """20 kB or more, with lines of over 500 bytes on average in the first 64 KiB."""
    head = F.left(text, F.lit(65536))
    lines = F.length(head) - F.length(F.translate(head, "\n", "")) + 1
    return (F.octet_length(text) >= 20_000) & (F.octet_length(head) / lines > 500)


def content_hash(content: Column, language: Column) -> Column:
    tagged = F.concat(F.encode(F.lit(VERSION), "UTF-8"), F.lit(b"\0"), content)
    return F.concat_ws(":", F.sha2(tagged, 256), language)


#: Files whose patterns say what is left out, in their folder and below; of one folder, the later has the last word.
IGNORE_FILES = (".gitignore", ".weftignore")


def ignore_rules(text: str, folder: str = "") -> list[tuple[str, str, bool, bool]]:
    """(folder, regular expression, whether it takes back, whether for folders only) of an ignore file's lines, in order."""
    out = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\) +$", "", line)
        if not line or line.startswith("#"):
            continue
        back, line = line.startswith("!"), line.removeprefix("!")
        only_folders, line = line.endswith("/"), line.rstrip("/")
        anchored, line = "/" in line, line.removeprefix("/")
        if not line:
            continue
        body, k = "", 0
        while k < len(line):
            if line.startswith("**/", k) and (k == 0 or line[k - 1] == "/"):
                body, k = body + "(?:.*/)?", k + 3
            elif line.startswith("/**", k) and k + 3 == len(line):
                body, k = body + "/.+", k + 3
            elif line[k] == "*":
                body, k = body + "[^/]*", k + 1
            elif line[k] == "?":
                body, k = body + "[^/]", k + 1
            elif line[k] == "[" and (end := line.find("]", k + 2)) > 0:
                inner = line[k + 1 : end].replace("\\", "\\\\")
                body, k = body + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", end + 1
            else:
                k += line[k] == "\\" and k + 1 < len(line)
                body, k = body + re.escape(line[k]), k + 1
        out.append((folder, ("" if anchored else "(?:.*/)?") + body, back, only_folders))
    return out


def is_ignored(path: str, rules: list[tuple[str, str, bool, bool]]) -> bool:
    """Whether the last rule that fits a path, or a folder above it, leaves it out; below such a folder nothing comes back."""
    parts = path.split("/")
    for n in range(1, len(parts) + 1):
        name, last = "/".join(parts[:n]), False
        for folder, pattern, back, only_folders in rules:
            inside = not folder or name.startswith(folder + "/")
            if inside and (n < len(parts) or not only_folders) and re.fullmatch(pattern, name[len(folder) + 1 if folder else 0 :], re.S):
                last = not back
        if last:
            return True
    return False


def tree_rules(spark: SparkSession, root: str, depth: int) -> list[tuple[str, str, bool, bool]]:
    """The rules of the ignore files in folders of up to ``depth`` names below ``root``, those of outer folders first.

    Spark's readers leave hidden files out, so that they are looked for by one pattern a depth.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(conf)
    top = fs.makeQualified(base).toUri().getPath().rstrip("/")
    rules = []
    for k in range(depth):
        found = []
        for n, name in enumerate(IGNORE_FILES):
            for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(root.rstrip("/") + "/*" * k + "/" + name)) or ():
                folder = status.getPath().getParent().toUri().getPath()[len(top) + 1 :]
                found.append((folder, n, status.getPath()))
        for folder, _, path in sorted(found, key=lambda x: x[:2]):
            stream = fs.open(path)
            try:
                rules += ignore_rules(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"), folder)
            finally:
                stream.close()
    return rules


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, kind, size_bytes, content_hash, text) of the files under ``root`` that are to be read.

    Any file system that Spark reads will do. Texts are null for media and for what is over the limits.
    What ignore files leave out is left out; their lines are gathered first, on the driver.
    """
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = re.sub(r"^[a-z][a-z0-9+.-]*:/+", "/", root.rstrip("/")) + "/"
    full = F.regexp_replace("path", r"^[a-z][a-z0-9+.-]*:/+", "/")
    path = F.when(F.contains(full, F.lit(base)), F.substring_index(full, base, -1)).otherwise(full)
    text = F.when(F.col("length") <= MAX_TEXT, F.decode("content", "UTF-8"))
    depth = files.agg(F.max(F.size(F.split(path, "/")))).first()[0] or 1
    rules = tree_rules(spark, root, depth)

    @F.pandas_udf("boolean")
    def ignored(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: is_ignored(p, rules)).astype(bool)

    first = F.decode(F.substring("content", 1, 200), "UTF-8")
    known = files.filter(F.col("length") <= MAX_ANY).select(path.alias("path"), F.col("length").alias("size_bytes"), "content", text.alias("text"), file_kind(path, first).alias("kind"))
    kept = known.filter(F.col("kind").isNotNull() & ~is_noise(F.col("path")) & ~F.col("path").rlike(SENSITIVE))
    if rules:
        kept = kept.filter(~ignored("path"))
    kept = kept.withColumn("text", F.when(F.col("kind").isin("code", "document"), F.col("text")))
    kept = kept.filter(~F.coalesce(looks_minified(F.col("text")), F.lit(False)) | (F.col("kind") != "code"))
    return kept.select("path", "kind", "size_bytes", content_hash(F.col("content"), extension(F.col("path"))).alias("content_hash"), "text")


def changes(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(file_path, status) of a tree against the manifest of the last run."""
    return manifest_diff(manifest, files.select(F.col("path").alias("file_path"), "content_hash"))


def freshness(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(status, n): how many files are new, changed, unchanged or removed."""
    return changes(manifest, files).groupBy("status").agg(F.count("*").alias("n"))


def cache_misses(files: DataFrame, cache: DataFrame) -> DataFrame:
    """The files whose (path, content_hash) has no record in the extraction cache."""
    known = cache.select(F.col("file_path").alias("path"), "content_hash")
    return files.join(known, ["path", "content_hash"], "left_anti")
