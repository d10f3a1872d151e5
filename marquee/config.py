"""Fixed values of the listings domain and the job parameters.

The lists below must hold exactly these entries, in this order, for results to be right: the order of the
aliases is the priority of a containment match, and the keyword rules are plain substrings.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

# --- fixed values: venue dimension (key, canonical name, aliases, calendar page, page profile) -------------
VENUES = [
    ("hi-tone", "Hi Tone", ["hi tone", "hi-tone", "hi tone café", "hi tone cafe", "the hi-tone"],
     "https://hitonecafe.com/events/", "hi_tone"),
    ("minglewood-hall", "Minglewood Hall", ["minglewood", "minglewood hall", "1555 madison"],
     "https://minglewoodhallmemphis.com/events/", "minglewood"),
    ("growlers", "Growlers", ["growlers", "growlers memphis"],
     "https://www.growlersmemphis.com/events", "growlers"),
    ("hernandos-hideaway", "Hernando's Hideaway",
     ["hernandos", "hernando's", "hernandos hideaway", "hernando's hideaway"],
     "https://hernandoshideawaymemphis.com/calendar/", "hernandos"),
    ("crosstown-arts", "Crosstown Arts",
     ["crosstown arts", "the green room", "green room crosstown", "crosstown concourse"],
     "https://crosstownarts.org/calendar/", "generic"),
    ("lafayettes", "Lafayette's Music Room",
     ["lafayettes", "lafayette's", "lafayettes music room", "lafayette's music room"],
     "https://www.lafayettes.com/music", "lafayettes"),
    ("overton-park-shell", "Overton Park Shell", ["levitt shell", "overton park shell", "the shell"],
     "https://www.levittshell.org/events", "overton_shell"),
    ("bb-kings", "B.B. King's Blues Club", ["bb kings", "b.b. kings", "b.b. king's", "bb king's blues club"],
     "https://www.bbkings.com/memphis", "generic"),
    ("graceland-soundstage", "Graceland Soundstage",
     ["graceland soundstage", "graceland live", "guest house theater"],
     "https://www.graceland.com/entertainment", "generic"),
    ("fedexforum", "FedExForum", ["fedexforum", "fedex forum"],
     "https://www.fedexforum.com/events", "generic"),
    ("germantown-pac", "Germantown Performing Arts Center",
     ["germantown performing arts", "germantown performing arts center", "gpac"],
     "https://www.gpacweb.com/event-list", "generic"),
    ("orpheum", "Orpheum Theatre", ["orpheum", "orpheum theatre", "halloran centre"], None, "manual_only"),
    ("bar-dkdc", "Bar DKDC", ["bar dkdc", "dkdc"], None, "manual_only"),
    ("bside", "B-Side Memphis", ["b-side", "bside", "b side", "b-side memphis"], None, "manual_only"),
]

# --- fixed values: rule keywords ----------------------------------------------------------------------------
EXCLUDE_KEYWORDS = [
    "comedy", "stand-up", "standup", "stand up", "comedian", "open mic comedy",
    "theatre", "theater", "play", "musical theater", "broadway",
    "art opening", "art show", "gallery opening", "exhibition",
    "poetry reading", "spoken word", "book signing", "book reading",
    "trivia", "trivia night", "bingo", "game night", "drag brunch",
    "networking", "mixer", "business",
    "yoga", "fitness", "wellness", "meditation",
    "film screening", "movie night",
    "paint and sip", "paint night", "craft night",
    "food truck", "farmers market",
]
INCLUDE_KEYWORDS = [
    "concert", "live music", "live band", "band", "dj", "dj night",
    "dance night", "electronic", "edm", "hip hop", "hip-hop",
    "r&b", "soul", "blues", "jazz", "rock", "punk", "metal",
    "country", "folk", "indie", "reggae", "gospel", "funk",
    "singer", "songwriter", "rapper", "mc ", "feat.", "featuring",
    "tour", "album release", "record release",
    "beats", "bass", "house music", "techno", "disco",
    "open mic", "jam session", "jam night", "karaoke",
]
CATEGORY_KEYWORDS = ["music", "concert", "festivals", "nightlife", "dj"]

# --- fixed values: labels and defaults ----------------------------------------------------------------------
TICKETING_API = "Ticketmaster"
SECOND_API = "Eventbrite"
SHEET = "Manual (Google Sheet)"
SHEET_LOCAL = "Manual (local CSV)"
ARTIFACTS = "Artifacts (Vision-Extracted)"
ARTIFACTS_CITY_PAGE = "Artifacts (Bandsintown page)"
MARKETPLACE = "DICE"
CITY_PAGE = "Bandsintown"
NEWSPAPER = "Memphis Flyer"
VENUE_TBA = "Venue TBA"
UNKNOWN_VENUE = "Unknown Venue"
CITY_DEFAULT = "Memphis, TN"
PREFERRED_SOURCES = ["Ticketmaster", "Venue:"]
MARKETPLACE_BASE = "https://dice.fm"
CITY_PAGE_BASE = "https://www.bandsintown.com"
NEWSPAPER_BASE = "https://www.memphisflyer.com"
IMAGE_SUFFIXES = [".png", ".jpg", ".jpeg", ".gif", ".webp"]
WEB_SUFFIXES = [".mhtml", ".html", ".htm"]
MAX_UPLOAD_BYTES = 20 * 1024 * 1024
CENTER_LAT, CENTER_LON, RADIUS_MILES = 35.1495, -90.0490, 30.0
LOCAL_ZONE = "America/Chicago"
MONTHS = ["January", "February", "March", "April", "May", "June", "July",
          "August", "September", "October", "November", "December"]
MSG_NO_TICKETING_KEY = "No API key configured (set TICKETMASTER_API_KEY)"
MSG_NO_SECOND_KEY = "No API token configured (set EVENTBRITE_API_TOKEN)"
MSG_NO_SHEET = "No Google Sheet URL or local CSV found"
MSG_EMPTY_SHEET = "CSV accessible but no events in date range"
MSG_NO_ARTIFACTS = "No artifacts found"
MSG_NO_ARTIFACT_DIR = "No artifacts/ folder found"
MSG_EMPTY_VENUE = "0 events parsed — page structure may have changed"
MSG_EMPTY_MARKETPLACE = "Page may require JS rendering — 0 events parsed"
MSG_EMPTY_CITY_PAGE = ("Page may require JS rendering — 0 events parsed. "
                       "Consider adding Bandsintown app_id for API access.")
MSG_NEWSPAPER_DOWN = "Could not access Memphis Flyer calendar — all URL patterns failed"
# --- end of fixed values ------------------------------------------------------------------------------------


def venue_aliases() -> list[tuple[int, str, str]]:
    """(rank, alias, canonical name) in priority order."""
    flat = [(alias, name) for _, name, aliases, _, _ in VENUES for alias in aliases]
    return [(rank, alias, name) for rank, (alias, name) in enumerate(flat)]


@dataclass(frozen=True)
class RunParams:
    """What a run depends on besides its inputs; passed in, never read from the clock inside a plan."""

    anchor_date: date
    horizon_days: int = 7
    run_ts: str = "1970-01-01 00:00:00"

    @property
    def end_date(self) -> date:
        return self.anchor_date + timedelta(days=self.horizon_days)

    @property
    def year(self) -> int:
        return self.anchor_date.year
