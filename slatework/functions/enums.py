"""Fixed values of the data model.

FIXED VALUES: these lists must equal the source application's enums and
workflow rules exactly, in this order, for results to match. They are
stated here plainly as data; every operator derives its logic from them.
"""

from __future__ import annotations

# -- fixed values ------------------------------------------------------------
ROLES = ["admin", "cm", "viewer"]
STATUSES = ["draft", "review", "approved", "published", "archived"]
PLATFORMS = ["instagram", "facebook", "twitter", "linkedin", "tiktok", "youtube", "other"]
CONTENT_TYPES = ["post", "story", "reel", "video", "carousel", "other"]

# status -> statuses it may move to, in the listed order; archived is terminal
TRANSITIONS = {
    "draft": ["review"],
    "review": ["draft", "approved"],
    "approved": ["published"],
    "published": ["archived"],
    "archived": [],
}

# display labels (dashboard wording and calendar wording differ for review)
DASHBOARD_STATUS_LABELS = {
    "draft": "Draft",
    "review": "In Review",
    "approved": "Approved",
    "published": "Published",
    "archived": "Archived",
}
CALENDAR_STATUS_LABELS = {
    "all": "All",
    "draft": "Draft",
    "review": "Review",
    "approved": "Approved",
    "published": "Published",
    "archived": "Archived",
}
PLATFORM_LABELS = {
    "all": "All platforms",
    "instagram": "Instagram",
    "facebook": "Facebook",
    "twitter": "Twitter",
    "linkedin": "LinkedIn",
    "tiktok": "TikTok",
    "youtube": "YouTube",
    "other": "Other",
}

# defaults of the write path
DEFAULT_ROLE = "viewer"
DEFAULT_PLATFORM = "other"
DEFAULT_CONTENT_TYPE = "post"
DEFAULT_STATUS = "draft"
DEFAULT_INVITE_MAX_USES = 10
DEFAULT_INVITE_HOURS = 7 * 24
RECENT_ITEMS_LIMIT = 10
DATE_FORMAT = "yyyy-MM-dd"
WORKSPACE_NAME_SUFFIX = "'s Workspace"

# error messages by code; {field}, {value}, {from} and {to} are filled in
ERROR_MESSAGES = {
    "required": "{field} is required",
    "invalid_enum": 'invalid {field}: "{value}"',
    "invalid_format": 'invalid {field}: "{value}" (expected YYYY-MM-DD)',
    "invalid_reference": "invalid {field}: does not belong to this workspace",
    "invalid_transition": "cannot transition from {from} to {to}",
    "not_found": "{field} not found",
    "forbidden": "insufficient role",
    "conflict": "{field} already exists",
    "unusable": "invite is expired or exhausted",
}
EXPECTED_DATE = "YYYY-MM-DD"
# -- end of fixed values -----------------------------------------------------

ENUMS = {
    "role": ROLES,
    "status": STATUSES,
    "platform": PLATFORMS,
    "content_type": CONTENT_TYPES,
}


def transition_pairs() -> list[tuple[str, int, str]]:
    """(from_status, position, to_status) rows of the workflow machine."""
    return [(src, i, dst) for src, dsts in TRANSITIONS.items() for i, dst in enumerate(dsts)]


def predecessor() -> dict[str, str]:
    """The single status each target may be reached from.

    Every target of the machine has exactly one source, which lets a
    transition request be written as a function on states: move to the
    target when the state is its source, otherwise stay.
    """
    pred: dict[str, str] = {}
    for src, dsts in TRANSITIONS.items():
        for dst in dsts:
            if dst in pred:
                raise ValueError(f"status {dst} has two sources")
            pred[dst] = src
    return pred
