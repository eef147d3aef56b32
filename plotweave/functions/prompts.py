"""Portrait prompt assembly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plotweave.functions.text import collapse, optional_text

# Fixed values.
BASE_STYLE = (
    "A single centered chest-up character portrait in a mature editorial gouache illustration style, "
    "flat matte gouache rendering, clean silhouette, minimal linework, soft paper texture, plain muted background, "
    "low-saturation palette, restrained literary mood, natural facial proportions, not cartoonish, not anime, "
    "not painterly, not photorealistic"
)
PROFILE_FORMAT = (
    "exactly one character, single centered chest-up bust portrait, one subject filling most of the frame, "
    "front-facing or slight three-quarter view, plain soft background, simple profile-card composition"
)
NEGATIVE_LAYOUT = (
    "no additional people, no duo, no pair, no group, no crowd, no background characters, "
    "no split composition, no diptych, no mirrored duplicate, no reflected second face, no twin, "
    "no interaction scene, no full body, no wide shot, no props, no scenery, no ornate background"
)
BANNED = [
    "duo portrait", "pair portrait", "group portrait", "double portrait", "multiple people",
    "multiple characters", "multiple figures", "two people", "two characters", "two figures",
    "crowd behind", "background characters", "split composition", "diptych",
    "mirrored second portrait", "mirror image", "reflected second face",
    "scene with another character", "interaction scene", "standing beside another character",
    "next to another character",
]
EDIT_PREFIX = (
    "Use the input image as a style reference only. Keep the same illustration style, framing, "
    "background simplicity, color palette, and rendering quality. Create a distinct person matching "
    "the target character profile. Do not copy the reference person's facial identity, age, gender, "
    "ethnicity, clothing, or exact features unless explicitly specified. "
)


def segment(c: Column) -> Column:
    """One line of text, null when empty."""
    return F.nullif(collapse(c), F.lit(""))


def without_banned(c: Column) -> Column:
    """Drop the comma or semicolon pieces that mention a banned phrase."""
    pieces = F.transform(F.split(segment(c), r"\s*[,;]+\s*"), segment)

    def allowed(piece: Column) -> Column:
        clean = piece.isNotNull()
        for phrase in BANNED:
            clean = clean & ~F.lower(piece).contains(phrase)
        return clean

    return F.nullif(F.array_join(F.filter(pieces, allowed), ", "), F.lit(""))


def portrait_prompt(book_prompt: Column, profile: Column, name: Column, base_style: Column | None = None) -> Column:
    """The five optional segments, joined by a comma."""
    style = F.lit(BASE_STYLE) if base_style is None else F.coalesce(segment(base_style), F.lit(BASE_STYLE))
    own = F.coalesce(segment(profile), F.concat(F.lit("single centered chest-up bust portrait of "), name))
    return F.concat_ws(
        ", ", style, F.lit(PROFILE_FORMAT), without_banned(book_prompt), without_banned(own), F.lit(NEGATIVE_LAYOUT)
    )


def edit_prompt(book_prompt: Column, profile: Column, name: Column) -> Column:
    return F.concat(F.lit(EDIT_PREFIX), portrait_prompt(book_prompt, profile, name))


def prompt_hash(c: Column) -> Column:
    """SHA-256 hex of a prompt; null stays null."""
    return F.sha2(optional_text(c), 256)
