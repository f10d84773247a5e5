"""Small word lists of our own, in a form that both engines read as SQL VALUES."""

#: English halves of part names and a Thai word for each.
EN_THAI = {
    "blue": "ฟ้า", "cold": "เย็น", "hot": "ร้อน", "large": "ใหญ่", "new": "ใหม่", "old": "เก่า", "red": "แดง", "small": "เล็ก",
    "anvil": "ทั่ง", "bolt": "สลัก", "gear": "เกียร์", "gizmo": "กลไก", "plate": "จาน", "ring": "แหวน", "rod": "กระบอง", "widget": "ของ",
}
#: How the Thai words of part names are romanized, syllable by syllable.
PART_ROMAN = {
    "ฟ้า": "fáa", "เย็น": "yen", "ร้อน": "rɔ́ɔn", "ใหญ่": "yài", "ใหม่": "mài", "เก่า": "gào", "แดง": "dɛɛng", "เล็ก": "lék",
    "ทั่ง": "tâng", "สลัก": "sà-làk", "เกียร์": "giia", "กลไก": "gon-gai", "จาน": "jaan", "แหวน": "wɛ̌ɛn", "กระบอง": "grà-bɔɔng", "ของ": "kɔ̌ɔng",
}
#: (thai, translit, priority, file, line_no): 0 marks exceptions; the same key twice is a conflict that the later line wins.
LEXICON = [
    ("ฟ้า", "fáa", 1, "a1.txt", 1), ("เย็น", "yen", 1, "a1.txt", 2), ("ร้อน", "rɔ́ɔn", 1, "a1.txt", 3), ("ใหญ่", "yài", 1, "a10.txt", 1), ("ใหม่", "mâi", 1, "a10.txt", 2),
    ("ใหม่", "mài", 1, "a2.txt", 1), ("แดง", "dɛɛng", 1, "a2.txt", 2), ("จาน", "jaan", 1, "a2.txt", 3), ("แหวน", "wɛ̌ɛn", 1, "a3.txt", 1), ("ของ", "kɔ̌ɔng", 1, "a3.txt", 2),
    ("ของ", "kǒng", 0, "x.txt", 1), ("ไก", "gai", 1, "a3.txt", 3), ("มา", "maa", 1, "a3.txt", 4), ("น้ำ", "náam", 1, "a3.txt", 5), ("น้ำแข็ง", "náam-kɛ̌ng", 1, "a3.txt", 6), ("ไป ไหน", "bpai nǎi", 1, "a3.txt", 7),
]
#: Words that exercise the rules.
WORDS = ["กอง", "บ้า", "สันต์", "พันธุ์", "เรียน", "เดือน", "กระทะ", "ตลาด", "ประเทศ", "น้ำแข็ง", "เพื่อน", "สวย", "ไม้", "หมา", "โรง", "แม่", "มาก", "นก", "เก้าอี้", "ๆ"]
#: Roman lines: golden text and a rendering of it.
PAIRS = [("sà-wàt-dii kráp", "sa wat dii kráp"), ("bpai nǎi maa", "bpai maa nǎi"), ("rák kun mâak", "rák kun mâak"), ("mâi bpen rai", "bpen rai"), ("kɔ̀ɔp-kun", "kɔ̀ɔp-kun"), ("a b c", "b c"), ("a b", "a x b")]


def values(rows, name: str, *cols: str) -> str:
    """``(VALUES ...) AS name(cols)`` for Spark and DuckDB alike."""
    lit = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r if isinstance(r, tuple) else (r,))) + ")" for r in rows) + f") AS {name}({', '.join(cols)})"


ROMAN_SQL = values(list(PART_ROMAN.items()), "pr", "thai", "translit")
EN_SQL = values(list(EN_THAI.items()), "en", "en", "thai")
LEX_SQL = values(LEXICON, "lex", "thai", "translit", "priority", "file", "line_no")
WORD_SQL = values(WORDS, "w", "word")
PAIR_SQL = values([(i + 1, *p) for i, p in enumerate(PAIRS)], "p", "n", "expected", "got")
