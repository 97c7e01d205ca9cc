"""How sensitive a path is, and which paths a shell command names. Column expressions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .values import _c

# The names that make a path sensitive.
KEY_NAMES = ("id_rsa", "id_ed25519", "id_ecdsa", "id_dsa", ".git-credentials")
KEY_EXTENSIONS = ("pem", "key", "p12", "pfx", "jks", "keystore")
KEY_FOLDERS = (".ssh", ".gnupg", ".aws", ".docker")
SECRET_NAMES = (".env", ".netrc", ".npmrc", ".pypirc", ".dockercfg", "credentials")
SECRET_PREFIXES = ("credentials", "secrets", ".env.")
SECRET_FOLDERS = (".kube", "gcloud")
RANKS = {"normal": 0, "sensitive": 1, "highly_sensitive": 2}

#: A shell word: quoted parts and bare characters up to a blank or an operator.
TOKEN = r"""(?:"[^"]*"?|'[^']*'?|[^ \t\n|;&"'])+"""


def _any(names) -> str:
    return "|".join(re.escape(n) for n in names)


# A path's last segment is followed by slashes at most, a folder in it by a slash and more; \z, as $ would also stand before a final line break. Names are told without regard to case, folders are not.
HIGHLY = rf"(?:^|/)(?i:{_any(KEY_NAMES)})/*\z|\.(?i:{_any(KEY_EXTENSIONS)})/*\z|(?:^|/)(?:{_any(KEY_FOLDERS)})/+[^/]"
SECRET = rf"(?:^|/)(?i:{_any(SECRET_NAMES)})/*\z|(?:^|/)(?i:{_any(SECRET_PREFIXES)})[^/]*/*\z|(?:^|/)(?:{_any(SECRET_FOLDERS)})/+[^/]"


def classify_path(path) -> Column:
    """normal, sensitive or highly_sensitive; the gravest rule that fits decides. Null paths are normal."""
    plain = F.translate(_c(path), "\\", "/")
    return F.when(plain.rlike(HIGHLY), "highly_sensitive").when(plain.rlike(SECRET), "sensitive").otherwise("normal")


def sensitivity_rank(sensitivity) -> Column:
    return F.when(_c(sensitivity) == "highly_sensitive", 2).when(_c(sensitivity) == "sensitive", 1).otherwise(0)


def named_paths(command) -> Column:
    """The command's sensitive path-like words, once each, in order: array<struct<path, sensitivity>>."""
    tokens = F.regexp_extract_all(F.coalesce(_c(command), F.lit("")), F.lit(TOKEN), F.lit(0))
    bare = F.transform(tokens, lambda t: F.regexp_replace(F.regexp_replace(t, r"""\"([^\"]*)\"?|'([^']*)'?""", "$1$2"), r"""^["'(),]+|["'(),]+\z""", ""))
    paths = F.array_distinct(F.filter(bare, lambda t: (t != "") & ~t.startswith("-") & (t.contains("/") | t.contains("."))))
    return F.filter(F.transform(paths, lambda p: F.struct(p.alias("path"), classify_path(p).alias("sensitivity"))), lambda s: s["sensitivity"] != "normal")


def worst_in_command(command) -> Column:
    worst = F.array_max(F.transform(named_paths(command), lambda s: sensitivity_rank(s["sensitivity"])))
    return F.when(worst == 2, "highly_sensitive").when(worst == 1, "sensitive").otherwise("normal")


def scan_commands(df: DataFrame, column: str = "command", id_column: str = "id") -> DataFrame:
    """One row a sensitive path of a command: id = command id, colon, place."""
    found = df.select("*", F.posexplode(named_paths(column)).alias("place", "found"))
    rest = [c for c in df.columns if c not in (column, id_column, "sensitivity")]
    return found.select(F.concat(F.col(id_column).cast("string"), F.lit(":"), F.col("place").cast("string")).alias("id"), F.col(id_column).alias("command_id"), *rest, F.col("found.path").alias("path"), F.col("found.sensitivity").alias("sensitivity"))
