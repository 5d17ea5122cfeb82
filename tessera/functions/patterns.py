"""Line and text patterns, in Java syntax with Unicode case and classes.

They are the rules of the text cleaner and its checks, and have to stay as they are for equal results.
"""

#: A line that holds only a page number.
PAGE_LINE = r"^\s*(стр\.?|страниц[аы]?|page)\s*\d+(\s*[\/\-]\s*\d+)?\s*$"
PAGE_DASH = r"^\s*[–—\-]\s*\d+\s*[–—\-]?\s*$"
#: Rules made of marks, bare numbers of up to four digits, lines of few punctuation marks.
JUNK_LINE = r"^\s*([_\-–—=•\*]{3,}|\d{1,4})\s*$"
PUNCT_LINE = r"^\s*[.,;:!?•*\-–—=\s]{1,10}\s*$"
ONE_LETTER_LINE = r"^\s*[A-Za-zА-Яа-яЁё]\s*$"
SYMBOLS_LINE = r"^\s*[^A-Za-zА-Яа-яЁё0-9]{6,}\s*$"
#: Lines about where the text comes from, at the head or tail of a document.
DOWNLOAD_LINE = r"^\s*Правила игры скачаны с\s+\S+\s*$"
MARKETING_LINE = r"^\s*(производител\w+\s+игр|российск\w+\s+сеть\s+магазин\w+)\b"
CREDITS_LINE = (
    r"^\s*(создател\w+|credits|credit|автор\w+|художник\w+|иллюстратор\w+|руководител\w+|организатор\w+|"
    r"редактор\w+|перевод\w+|корректор\w+|русск\w+\s+издани\w+|published\s+by)\b"
)
RIGHTS = r"(воспроизведени\w+.*без\s+разрешени\w+.*запрещен\w+|перепечатк\w+\s+и\s+публик\w+|without\s+permission|all\s+rights\s+reserved)"
TRADEMARK = r"(товарн\w+\s+знак|trademark|registered\s+trademark|®|™)"
COMPANY = r"\b(ооо|llc|gmbh|inc\.?)\b"
#: Structure.
BULLET = r"^\s*((\d+(\.\d+){0,5}[.)])|([a-zа-яё]\))|([\-–—•]))\s+"
SECTION = r"^\s*(раздел|глава|приложение)\b"
PHASE = r"^\s*(ФАЗА|ШАГ|PHASE|STEP)\s+\d"
RULES_SECTION = (
    r"^\s*(Подготовка к игре|Компоненты\b|Игровой процесс|Конец игры|Подсчёт очков|Описание\b|Правила игры|"
    r"Setup\b|Components\b|Gameplay\b|End of game\b|Scoring\b)\s*:?\s*$"
)
REPEATED_PHRASE = r"(\S+(?:\s+\S+)+?) \1"
#: Words with hyphens, section numbers, numbers and ranges.
CORPUS_TOKEN = r"[A-Za-zА-Яа-яЁё]+(?:-[A-Za-zА-Яа-яЁё]+)*|\d+(?:\.\d+){1,6}|\d+(?:[.,]\d+)?(?:[–-]\d+(?:[.,]\d+)?)?"
SENTENCE_END = r"(?<!\d)[.!?]+(?!\d)(?=(?:\s|$))"
#: Words of advice, which a question about rules doesn't hold.
FORBIDDEN = r"\b(лучше|выгодн\w*|стоит\s+ли|оптимальн\w*|тактик\w*|стратег\w*)\b"
BARE_NUMERIC = r"^\s*[\d\s\-,\.]+\s*$"
SCORE_TOKEN = r"[0-9]+|[a-zа-яё]+"


def java(pattern: str) -> str:
    """For rlike and its like: Unicode letter case and classes."""
    return f"(?iuU){pattern}"
