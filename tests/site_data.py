"""A small literal site, the notes of a garden club, and what was fetched from its neighbours."""

TIPS = "https://garden.example.org/tips"
OLD = "http://old.example.org/advice"
DRAFT = "https://notes.example.net/draft"
LIVE = DRAFT.replace("/draft", "/live")

SOIL = f"""# Soil

Draw the [bed plan](beds.md) first, then mark its [rows](beds.md#rows).
What was in the [cellar](cellar.md) is gone.

## Compost `NPK`
The [mix](#compost-npk) is the same as in [SOIL](#SOIL),
but nothing here is about [roots](#roots) or [worms][w].

More: <{TIPS}/mulch> and [how deep]({TIPS}/mulch#depth).

[w]: beds.md#worms
"""
BEDS = """Beds
====

### Rows
Back to the [soil](./soil.md).
"""
SIGNS = """From the gate: [beds](/garden/beds.md), the [shed door](/garden/shed.md#door),
the [rows](/garden/beds.md#rows) and some [weeds](/garden/beds.md#weeds).
"""
MOVED = f"1. [advice]({OLD})\n2. [advice on depth]({OLD}#depth)\n3. [advice on width]({OLD}#width)\n"
DRAFTS = f"> [harvest]({DRAFT}/harvest)\n>\n> [frost]({DRAFT}/frost)\n"

SITE = {
    "club/garden/soil.md": SOIL,
    "club/garden/beds.md": BEDS,
    "club/signs.md": SIGNS,
    "club/moved.md": MOVED,
    "club/drafts.md": DRAFTS,
}
#: Links in all pages.
N_LINKS = 19

MULCH = b'<main><a name="md-depth"></a><p id="width">Spread it.</p></main>'
RESPONSES = [
    (OLD, 301, "https://garden.example.org/tips/mulch", None, None, None),
    (f"{TIPS}/mulch", 200, None, "text/html", MULCH, None),
    (f"{LIVE}/harvest", 200, None, "text/plain; charset=utf-8", b"Baskets.", None),
    (f"{LIVE}/frost", 410, None, "text/html", b"", None),
]
