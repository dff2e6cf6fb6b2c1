"""Options and fixed values.

The strings under FIXED VALUES must equal the original application's text for
results (passage text, prompts, markers, context blocks) to match. They are
stated plainly and kept together here; every operator takes them as
parameters so a user can swap them.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the original application's strings and parameters)
# ---------------------------------------------------------------------------

# Recursive chunker: size, overlap, separators in priority order.
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 100
CHUNK_SEPARATORS = ("\n\n", "\n", ".", " ", "")

# Passage text embedded at index time: law line, article line with title,
# 1-based part line, then the chunk.
PASSAGE_TEMPLATE = "Luật: {law}\nĐiều {article}: {title}\nPhần {part}/{total}:\n{chunk}"

# Hit formatter of the plain (no rerank) path.
PLAIN_LAW_LABEL = "Luật: "
PLAIN_ARTICLE_LABEL = "Điều "
CONTENT_LABEL = "Nội dung: "

# Hit formatter of the rerank path: content longer than 800 is cut to 797 + "...".
RERANK_CONTENT_MAX = 800
RERANK_CONTENT_KEEP = 797
RERANK_ELLIPSIS = "..."
# Scorer input: the formatted text is cut to its first 800 characters.
SCORER_INPUT_MAX = 800

# Rewriter output marker and the number of kept rewrites.
REWRITE_MARKER = "### Rewritten Queries:"
REWRITE_NUMBERS = ("1", "2", "3")
MAX_REWRITES = 3
REWRITE_PROMPT_TEMPLATE = (
    "\n    ### Instruction:\n    Rewrite the given query into three different variations.\n\n"
    "    ### Input Query:\n    {query}\n\n    ### Rewritten Queries:\n    "
)

# Context assembly.
CONTEXT_HEADER_TEMPLATE = "Document (Relevance Score: {score}):\n{doc}"
CONTEXT_SEPARATOR = "\n\n=== Next Document ===\n\n"
NO_RERANK_SCORE = 1.0

# Answer prompt; the answer marker closes it.
ANSWER_MARKER = "Trả lời dựa trên các điều luật trên:"
ANSWER_PROMPT_TEMPLATE = (
    "Hãy trả lời câu hỏi dựa trên các thông tin pháp luật sau đây một cách rõ ràng và chính xác.\n\n"
    "        Thông tin pháp luật:\n        {context}\n\n        Câu hỏi: {query}\n\n"
    "        Trả lời dựa trên các điều luật trên:\n        "
)

# Request routing: accepted choices, the word that ends a session.
ROUTE_CHOICES = ("1", "2")
EXIT_WORD = "exit"

# Route configuration: route -> model kind, rerank cut (top_k), context limit.
# The class default top_k is 5; route 1 uses 1, route 2 uses 4.
ROUTE_CONFIG = (
    ("1", "gpt2", 1, 1),
    ("2", "llama", 4, 4),
)
DEFAULT_TOP_K = 5
DEFAULT_MODEL_KIND = "gpt2"
RETRIEVAL_DEPTH = 10

# Stored vector size.
EMBED_DIM = 384

# ---------------------------------------------------------------------------
# Our own defaults (not from the original application)
# ---------------------------------------------------------------------------

# Token rule shared by the hashed encoder, BM25 and the default rewriter:
# lower-case, maximal runs of Unicode letters or digits.
TOKEN_PATTERN = r"[\p{L}\p{N}]+"
# BM25 parameters (Robertson & Zaragoza 2009).
BM25_K1 = 1.2
BM25_B = 0.75
# Rank keys are cosine / score rounded to this many decimals, then ids:
# removes last-bit noise between summation orders.
RANK_DECIMALS = 9


@dataclass(frozen=True)
class RagOptions:
    """Switches of the answer job (use_reranking, use_query_rewriting, top_k, model kind)."""

    use_reranking: bool = True
    use_query_rewriting: bool = True
    top_k: int = DEFAULT_TOP_K
    model_kind: str = DEFAULT_MODEL_KIND
    depth: int = RETRIEVAL_DEPTH
    doc_limit: int | None = None  # None -> 1 for gpt2, 4 otherwise
    dedupe_keep: str = "first"  # "first" (original behaviour) or "best"

    def resolved_doc_limit(self) -> int:
        if self.doc_limit is not None:
            return self.doc_limit
        return 1 if self.model_kind == "gpt2" else 4
