"""Function rules: a fixed table first, contracts read from documentation second."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MUST_CHECK, DANGEROUS, FORMAT = 1, 2, 4

# The functions that have a rule of their own, by what the rule says.
_MUST_CHECK = """
read write pread pwrite lseek fsync fdatasync
open openat close dup dup2 dup3 pipe pipe2 ftruncate fchmod fchown fcntl ioctl
fopen freopen fdopen fclose fflush fread fwrite fgetc fputc fgets fputs fseek ftell ferror feof
malloc calloc realloc strdup strndup posix_memalign aligned_alloc
socket accept accept4 connect listen bind send recv sendto recvfrom sendmsg recvmsg getsockopt setsockopt shutdown
fork vfork wait waitpid waitid system execve execl execlp execv execvp execvpe
chdir fchdir mkdir mkdirat rmdir unlink unlinkat rename renameat link linkat symlink symlinkat readlink readlinkat realpath
stat fstat lstat access faccessat
mkstemp mkdtemp
getline getdelim
clock_gettime nanosleep
pthread_create pthread_join pthread_mutex_init pthread_mutex_lock pthread_mutex_unlock
pthread_rwlock_init pthread_rwlock_rdlock pthread_rwlock_wrlock pthread_rwlock_unlock
pthread_cond_init pthread_cond_wait pthread_cond_signal pthread_cond_broadcast
getaddrinfo getnameinfo inet_pton inet_ntop
setenv unsetenv putenv chown chmod umask
"""
_DANGEROUS = "gets strcpy strcat strncpy strncat tmpnam mktemp strtok"
_DANGEROUS_FORMAT = "sprintf vsprintf scanf fscanf sscanf"
_FORMAT = "printf fprintf dprintf vprintf vfprintf"
_FORMAT_MUST_CHECK = "snprintf vsnprintf asprintf vasprintf"
# Where the format stands among the arguments.
FORMAT_INDEX = {
    **dict.fromkeys("printf vprintf scanf".split(), 0),
    **dict.fromkeys("fprintf vfprintf fscanf dprintf sprintf vsprintf sscanf asprintf vasprintf".split(), 1),
    **dict.fromkeys("snprintf vsnprintf".split(), 2),
}
# Where documentation warns, and how.
WARNING_SECTIONS = ("DESCRIPTION", "NOTES", "BUGS", "CAVEATS", "WARNINGS")
WARNING_PHRASES = (
    "deprecated", "obsolete", "should not be used", "do not use", "is dangerous", "security risk",
    "use of this function is discouraged", "is unsafe", "never use", "avoid this function",
)

STATIC = {
    **dict.fromkeys(_MUST_CHECK.split(), MUST_CHECK),
    **dict.fromkeys(_DANGEROUS.split(), DANGEROUS),
    **dict.fromkeys(_DANGEROUS_FORMAT.split(), DANGEROUS | FORMAT),
    **dict.fromkeys(_FORMAT.split(), FORMAT),
    **dict.fromkeys(_FORMAT_MUST_CHECK.split(), FORMAT | MUST_CHECK),
}


def static_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*STATIC.items()], "name string, flags int")


def two_tier(first: DataFrame, second: DataFrame, key: str = "name") -> DataFrame:
    """Rows of first; rows of second only for keys that first does not have."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti").select(first.columns))


def category(flags: Column) -> Column:
    """The name of the gravest thing the flags say."""
    said = lambda bit: flags.bitwiseAND(bit) != 0
    return F.when(said(DANGEROUS), "dangerous_function").when(said(FORMAT), "format_string").when(said(MUST_CHECK), "return_value_check").otherwise("other")


def mentions_any(text: Column, phrases=WARNING_PHRASES) -> Column:
    lowered = F.lower(text)
    out = F.lit(False)
    for p in phrases:
        out = out | lowered.contains(p)
    return out


def section_flags(name: Column, content: Column) -> Column:
    """What one section of a page says about its function, as flags."""
    must = F.when(name.ilike("%RETURN VALUE%"), MUST_CHECK).otherwise(0)
    danger = F.when(name.isin(*WARNING_SECTIONS) & mentions_any(content), DANGEROUS).otherwise(0)
    form = F.when((name == "SYNOPSIS") & content.contains("...") & (content.contains("format") | content.contains("fmt")), FORMAT).otherwise(0)
    return must.bitwiseOR(danger).bitwiseOR(form)


def names_of(functions: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, id): every name under which a function is known."""
    return functions.select("name", "id").unionByName(aliases.select(F.col("alias_name").alias("name"), F.col("function_id").alias("id"))).distinct()


def contract_rules(functions: DataFrame, sections: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, flags) of every documented name with at least one flag: one pass over the sections answers all questions for all names."""
    said = sections.select("function_id", section_flags(F.col("section_name"), F.col("content")).alias("flags")).where("flags <> 0").groupBy(F.col("function_id").alias("id")).agg(F.bit_or("flags").alias("flags"))
    return names_of(functions, aliases).join(said, "id").groupBy("name").agg(F.bit_or("flags").cast("int").alias("flags"))


def rules(spark: SparkSession, contracts: DataFrame | None = None) -> DataFrame:
    """All rules; a name of the fixed table is never looked up in the contracts."""
    fixed = static_rules(spark)
    return fixed if contracts is None else two_tier(fixed, contracts)


def contract_answer(contracts: DataFrame, names: DataFrame, flag: int) -> DataFrame:
    """(name, answer) for asked names: whether the documentation gives the flag."""
    return names.select("name").distinct().join(contracts, "name", "left").select("name", (F.coalesce(F.col("flags"), F.lit(0)).bitwiseAND(flag) != 0).alias("answer"))
