"""Fixed values of Thai orthography and of the romanization: letters, sounds, tone classes, numerals."""

# Initial sounds.
INITIAL = {
    "ก": "g", "ข": "k", "ฃ": "k", "ค": "k", "ฅ": "k", "ฆ": "k", "ง": "ng", "จ": "j", "ฉ": "ch", "ช": "ch", "ซ": "s", "ฌ": "ch",
    "ญ": "y", "ฎ": "d", "ฏ": "dt", "ฐ": "t", "ฑ": "t", "ฒ": "t", "ณ": "n", "ด": "d", "ต": "dt", "ถ": "t", "ท": "t", "ธ": "t",
    "น": "n", "บ": "b", "ป": "bp", "ผ": "p", "ฝ": "f", "พ": "p", "ฟ": "f", "ภ": "p", "ม": "m", "ย": "y", "ร": "r", "ฤ": "rʉ",
    "ล": "l", "ฦ": "lʉ", "ว": "w", "ศ": "s", "ษ": "s", "ส": "s", "ห": "h", "ฬ": "l", "อ": "", "ฮ": "h",
}
# Final sounds.
FINAL = {
    "ก": "k", "ข": "k", "ฃ": "k", "ค": "k", "ฅ": "k", "ฆ": "k", "ง": "ng", "จ": "t", "ฉ": "t", "ช": "t", "ซ": "t", "ฌ": "t",
    "ญ": "n", "ฎ": "t", "ฏ": "t", "ฐ": "t", "ฑ": "t", "ฒ": "t", "ณ": "n", "ด": "t", "ต": "t", "ถ": "t", "ท": "t", "ธ": "t",
    "น": "n", "บ": "p", "ป": "p", "ผ": "p", "ฝ": "p", "พ": "p", "ฟ": "p", "ภ": "p", "ม": "m", "ย": "i", "ร": "n", "ล": "n",
    "ว": "o", "ศ": "t", "ษ": "t", "ส": "t", "ห": "", "ฬ": "n", "อ": "", "ฮ": "",
}
# Tone classes; letters in neither are mid.
HIGH, LOW = "ขฃฉฐถผฝศษสห", "คฅฆงชซฌญฑฒณทธนพฟภมยรลวฬฮ"
# Clusters and their sounds; those that begin with ห take the high class.
CLUSTERS = {
    "กร": "gr", "กล": "gl", "กว": "gw", "ขร": "kr", "ขล": "kl", "ขว": "kw", "คร": "kr", "คล": "kl", "คว": "kw", "ปร": "bpr", "ปล": "bpl",
    "พร": "pr", "พล": "pl", "ผล": "pl", "ฟร": "fr", "ฟล": "fl", "ตร": "dtr", "ทร": "s", "ดร": "dr", "หร": "r", "หล": "l", "หม": "m",
    "หน": "n", "หว": "w", "หย": "y", "หง": "ng", "สร": "s", "ศร": "s", "ซร": "s", "สว": "sw", "ซว": "sw", "บร": "br", "บล": "bl",
}
# Numerals.
UNITS = ["", "nʉ̀ng", "sɔ̌ɔng", "sǎam", "sìi", "hâa", "hòk", "jèt", "bpɛ̀ɛt", "gâao"]
TENS = ["", "sìp", "yîi sìp", "sǎam sìp", "sìi sìp", "hâa sìp", "hòk sìp", "jèt sìp", "bpɛ̀ɛt sìp", "gâao sìp"]
ZERO, ELEVENTH = "sǔun", "èt"

# Character classes, for use inside brackets.
CONSONANT = "ก-ฮ"
LEADING = "เแโใไ"
VOWEL = "ะัาิีึืุูเแโใไๅำ"
TONE = "่้๊๋"
OTHER_MARK = "็์ํๆ"
ROMAN_VOWEL = "aeiouəɛɔʉ"
#: Combining marks of tones 1 to 4: low, high, falling, rising.
TONE_MARKS = ["̀", "́", "̂", "̌"]
#: Letters that have a precomposed form with each tone mark, in the order of TONE_MARKS.
PRECOMPOSED = {"a": "àáâǎ", "e": "èéêě", "i": "ìíîǐ", "o": "òóôǒ", "u": "ùúûǔ"}
