"""Sequence column functions: SMILES tokens, cut, vocabulary ids, atom mask,
protein preparation, batch padding (F1-F9, P9, P10).

All of them are built-in Column expressions (regexp_extract_all, transform,
map lookups), so they run in the JVM inside whole-stage code generation; no
Python worker is involved.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference for identical tokens and ids).
# ---------------------------------------------------------------------------

# SMILES token pattern: ordered alternatives, first match wins.
SMILES_PATTERN = (
    r"(\[[^\]]+]|Br?|Cl?|N|O|S|P|F|I|b|c|n|o|s|p|\(|\)|\.|=|#|-|\+|\\|\/|:|~|@|\?|>|\*|\$|\%[0-9]{2}|[0-9])"
)

# Vocabulary in id order (id = position).
VOCAB = [
    "[PAD]", "[GLO]", "c", "C", "(", ")", "O", "1", "2", "=", "N", "3", "n", "4",
    "[C@H]", "F", "[C@@H]", "-", "S", "/", "Cl", "[nH]", "s", "o", "5", "#",
    "[C@]", "[C@@]", "\\", "[O-]", "[N+]", "Br", "6", "P", "[n+]", "7", "I",
    "[S+]", "8", "[N-]", "[Si]", "B", "9", "[2H]", "[Se]", "[other_atom]",
    "[other_token]",
]

# Tokens that are atoms (mask 1).
ATOM_TOKENS = [
    "c", "C", "O", "N", "n", "[C@H]", "F", "[C@@H]", "S", "Cl", "[nH]", "s", "o",
    "[C@]", "[C@@]", "[O-]", "[N+]", "Br", "P", "[n+]", "I", "[S+]", "[N-]",
    "[Si]", "B", "[Se]", "[other_atom]",
]

MAX_TOKENS = 200          # token limit; sequences get one extra prefix token
PAD, GLO = "[PAD]", "[GLO]"
OTHER_ATOM, OTHER_TOKEN = "[other_atom]", "[other_token]"

# Protein preparation: rare residues replaced by X, direction prefixes.
RARE_RESIDUES = "[UZOB]"
PREFIX_AA = "<AA2fold>"
PREFIX_FOLD = "<fold2AA>"

# ---------------------------------------------------------------------------

def _vocab_map() -> Column:
    return F.create_map(*[c for i, t in enumerate(VOCAB) for c in (F.lit(t), F.lit(i))])


def smiles_tokens(s: Column) -> Column:
    """array of tokens in match order; unmatched characters are dropped."""
    return F.regexp_extract_all(s, F.lit(SMILES_PATTERN), F.lit(1))


def dropped_chars(s: Column, tokens: Column) -> Column:
    """Characters of ``s`` not covered by any token (tokens do not overlap,
    so the covered count is the length of the concatenated tokens)."""
    return F.length(s) - F.length(F.array_join(tokens, ""))


def fits(tokens: Column, max_tokens: int = MAX_TOKENS) -> Column:
    """The token count is at most ``max_tokens``."""
    return F.size(tokens) <= max_tokens


def middle_chars(s: Column, length: int = MAX_TOKENS) -> Column:
    """when longer than ``length`` characters keep ``length`` characters
    starting at ``(len - length) // 2``."""
    n = F.length(s)
    start = (F.floor((n - F.lit(length)) / 2) + 1).cast("int")
    return F.when(n > length, F.substr(s, start, F.lit(length))).otherwise(s)


def cut_smiles(s: Column, max_tokens: int = MAX_TOKENS) -> Column:
    """unchanged when it has at most ``max_tokens`` tokens, else its middle
    ``max_tokens`` characters (which never give more tokens than characters)."""
    return F.when(F.size(smiles_tokens(s)) > max_tokens, middle_chars(s, max_tokens)).otherwise(s)


def cut_tokens(s: Column, tokens: Column, max_tokens: int = MAX_TOKENS) -> Column:
    """Tokens of ``cut_smiles(s)`` given the already computed ``tokens`` of
    ``s``: the whole text is tokenized once, the middle part only when cut."""
    return F.when(F.size(tokens) > max_tokens, smiles_tokens(middle_chars(s, max_tokens))).otherwise(tokens)


def padded_tokens(tokens: Column, max_tokens: int = MAX_TOKENS) -> Column:
    """``[GLO]`` + tokens + ``[PAD]`` up to ``max_tokens + 1`` entries."""
    n_pad = F.greatest(F.lit(max_tokens) - F.size(tokens), F.lit(0))
    return F.concat(F.array(F.lit(GLO)), tokens, F.array_repeat(F.lit(PAD), n_pad))


def canonical_tokens(tokens: Column) -> Column:
    """Unknown bracket tokens -> ``[other_atom]``, other unknowns -> ``[other_token]``."""
    vm = _vocab_map()
    return F.transform(
        tokens,
        lambda t: F.when(F.element_at(vm, t).isNotNull(), t)
        .when(F.instr(t, "[") > 0, F.lit(OTHER_ATOM))
        .otherwise(F.lit(OTHER_TOKEN)),
    )


def token_ids(tokens: Column, max_tokens: int = MAX_TOKENS) -> Column:
    """F4 + P10: vocabulary ids of the padded sequence (:func:`encode_ids`),
    NULL unless it has exactly ``max_tokens + 1`` entries (too many tokens)."""
    return F.when(F.size(tokens) <= max_tokens, encode_ids(tokens, max_tokens))


def atom_mask(tokens: Column, max_tokens: int = MAX_TOKENS) -> Column:
    """1 for atom tokens and unknown bracket tokens; ``[2H]`` is known but
    not an atom (0)."""
    return mask_from_ids(encode_ids(tokens, max_tokens))


def mask_positions(mask: Column) -> Column:
    """0-based indexes where the mask is 1 (the mask is read once)."""
    marked = F.transform(mask, lambda m, i: F.when(m == 1, i).otherwise(F.lit(-1)))
    return F.filter(marked, lambda i: i >= 0)


def protein_spaced(s: Column) -> Column:
    """rare residues (upper case U Z O B) -> X, one blank between residues."""
    return F.array_join(F.split(F.regexp_replace(s, RARE_RESIDUES, "X"), ""), " ")


def is_upper(s: Column) -> Column:
    """Python ``str.isupper``: at least one cased character, none lower case."""
    return (F.upper(s) == s) & (F.lower(s) != s)


def protein_prepare(s: Column) -> Column:
    """F7 + F8: the prepared encoder input with its direction prefix."""
    spaced = protein_spaced(s)
    prefix = F.when(is_upper(spaced), F.lit(PREFIX_AA)).otherwise(F.lit(PREFIX_FOLD))
    return F.concat(prefix, F.lit(" "), spaced)


def batch_padding(seq_len: Column, batch: Column) -> tuple[Column, Column]:
    """(padded length, pad count) when each batch is padded to its longest
    sequence.  The window is partitioned by the batch key, whose size is the
    batch size (a parameter), never a whole table."""
    w = Window.partitionBy(batch)
    padded = F.max(seq_len).over(w)
    return padded, padded - seq_len


def vocabulary_table(spark):
    """The fixed vocabulary as a small table ``(token, token_id, is_atom)``
    (47 rows, safe to broadcast)."""
    atoms = set(ATOM_TOKENS)
    rows = [(t, i, 1 if t in atoms else 0) for i, t in enumerate(VOCAB)]
    return spark.createDataFrame(rows, "token string, token_id int, is_atom int")


def encode_tokens_long(df, id_col: str, tokens: str, max_tokens: int = MAX_TOKENS):
    """F4 + F5 in long form: one row per position of the padded sequence with
    ``pos, token_id, atom`` - explode + broadcast hash join on the fixed
    vocabulary, all in generated code (no per-token lambda lookups).  Rows of
    sequences longer than ``max_tokens`` are still produced; callers check
    P10 on the array size."""
    from pyspark.sql import functions as F
    voc = F.broadcast(vocabulary_table(df.sparkSession))
    t = df.select(id_col, F.posexplode(padded_tokens(F.col(tokens), max_tokens)).alias("pos", "token"))
    j = t.join(voc, "token", "left")
    bracket = F.instr(F.col("token"), "[") > 0
    tid = F.coalesce(F.col("token_id"), F.when(bracket, F.lit(VOCAB.index(OTHER_ATOM)))
                     .otherwise(F.lit(VOCAB.index(OTHER_TOKEN))))
    atom = F.coalesce(F.col("is_atom"), F.when(bracket, F.lit(1)).otherwise(F.lit(0)))
    return j.select(id_col, F.col("pos").cast("int").alias("pos"), tid.cast("int").alias("token_id"),
                    atom.cast("int").alias("atom"))


def encode_ids(tokens: Column, max_tokens: int = MAX_TOKENS) -> Column:
    """F4 in one pass: ids of ``[GLO] + tokens + [PAD]...``, unknown bracket
    tokens -> the other-atom id, other unknowns -> the other-token id (one
    map lookup per token).  Not length-checked; see :func:`token_ids`."""
    vm = _vocab_map()
    other_atom, other_token = VOCAB.index(OTHER_ATOM), VOCAB.index(OTHER_TOKEN)
    return F.transform(
        padded_tokens(tokens, max_tokens),
        lambda t: F.coalesce(F.element_at(vm, t),
                             F.when(F.instr(t, "[") > 0, F.lit(other_atom)).otherwise(F.lit(other_token))))


def mask_from_ids(ids: Column) -> Column:
    """F5 from ids: an O(1) index into a per-id atom flag array."""
    atoms = set(ATOM_TOKENS)
    flags = F.array(*[F.lit(1 if t in atoms else 0) for t in VOCAB])
    return F.transform(ids, lambda i: F.element_at(flags, i + 1))
