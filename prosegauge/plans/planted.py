"""Sentences added to the test tables, alike in Spark and in SQL, so that every operator has something to find.

The invented prose of the tables holds none of the words and shapes that the
checks look for. The document's number chooses what is added to it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLANTS = [
    "",
    " Furthermore, we leverage a robust landscape. Moreover, it delves deeper and is leveraging synergy. However, this enhances a cutting edge tapestry, and a treasure trove.",
    "\n\nThis article will explore how markets changed over the years. It was slow. It was costly.\n\nPeople waited in long lines for bread and milk. They talked about the weather. They went home at dusk.\n\nTrade grew in the harbour towns along the coast. Ships came in. Sailors went out.\n\nIn conclusion, markets changed over the years and this article will stop. It was slow. It was costly.",
    "\n# Big Plans For Winter\n- **First point** is short\n- **Second point** is longer\n* **Third point** ends here\n## notes\n### more notes\n#### even more\nDr. Smith met Mr. Jones in the U.S.A. yesterday. They spoke (briefly). \"Good,\" he said. \"Very good!\" Then they left... Nothing came of it.",
    " It's not a bug, it's a feature. The result? It was worse than before. On the one hand it rains, on the other hand it pours. Just as the river bends toward the sea, just as the road bends. This is not an exhaustive list. The team stayed late, fixing old pipes.",
    " Honestly, this is amazing! Amazing and truly incredible. I mean, it might work, perhaps it could, and it's very likely. Don't worry, you'll see. We're done. Government education and happiness lead to fragmentation. And so it goes. But why? So be it. In many cases it seems fine.",
    " At the end of the day, we pave the way for growth. In conclusion, feel free to reach out. It's worth noting that experts argue. Great question. Let's dive in. Let's dive in again.",
    " Rivers run. Rivers bend. Rivers dry. Rivers flood the plain each spring. The therefore was thus; hence, indeed, however. Apples, pears, and plums were sold. Tea, milk, and honey too. Bread, salt, and oil as well.",
    " Wait -- a dash—and another – here--not. “Quoted,” she wrote; ‘single’ too: yes? No! аpple рeаr ᴍɢ zero​width so­ft café naïve.",
    " Window window door window lamp lamp door window lamp door garden garden window garden lamp. The window closed. The door shut. The lamp failed. The garden slept.",
    "\r\nOne line\r\nTwo lines three lines\x0bfour lines\nA very long-winded and remarkably, significantly, profoundly nuanced, multifaceted statement.",
]


def planted(text: str = "text", key: str = "doc_id") -> Column:
    out = F.lit("")
    for i, p in enumerate(PLANTS):
        out = F.when(F.pmod(F.expr(key), F.lit(len(PLANTS))) == i, F.lit(p)).otherwise(out)
    return F.concat(F.coalesce(F.col(text), F.lit("")), out)


def literal(text: str) -> str:
    """A SQL string, with characters outside printable ASCII by number."""
    parts, run = [], ""
    for c in text:
        if " " <= c <= "~":
            run += "''" if c == "'" else c
        else:
            if run:
                parts.append(f"'{run}'")
                run = ""
            parts.append(f"chr({ord(c)})")
    if run or not parts:
        parts.append(f"'{run}'")
    return "(" + " || ".join(parts) + ")"


def planted_sql(text: str = "text", key: str = "doc_id") -> str:
    return f"coalesce({text}, '') || CASE {key} % {len(PLANTS)} " + " ".join(f"WHEN {i} THEN {literal(p)}" for i, p in enumerate(PLANTS)) + " END"
