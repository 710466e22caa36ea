"""Titles and descriptions of rule codes, as shown to users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Title of each code, and the description of any.
TITLES = {
    "TITLE_MISSING": "عنوان صفحه وجود ندارد",
    "TITLE_LENGTH": "طول عنوان صفحه مناسب نیست",
    "META_DESCRIPTION_MISSING": "توضیحات متا وجود ندارد",
    "META_DESCRIPTION_LENGTH": "طول توضیحات متا مناسب نیست",
    "H1_MISSING": "عنوان H1 وجود ندارد",
    "MULTIPLE_H1": "چند عنوان H1 در صفحه وجود دارد",
    "CANONICAL_MISSING": "Canonical صفحه وجود ندارد",
    "CANONICAL_INVALID": "Canonical صفحه معتبر نیست",
    "CANONICAL_MISMATCH": "Canonical با URL صفحه همخوان نیست",
    "NOINDEX": "صفحه Noindex است",
    "HTTPS_ISSUE": "صفحه با HTTPS ارائه نشده است",
    "LOW_WORD_COUNT": "محتوای صفحه کم است",
    "ALT_MISSING": "تصویر بدون متن جایگزین وجود دارد",
    "SLOW_RESPONSE": "پاسخ صفحه کند است",
    "HEADING_STRUCTURE": "ساختار تیترها پرش دارد",
    "DUPLICATE_CONTENT": "محتوای تکراری شناسایی شد",
    "NEAR_DUPLICATE_CONTENT": "محتوای بسیار مشابه شناسایی شد",
    "ORPHAN_PAGE": "صفحه یتیم است و لینک داخلی ندارد",
    "REDIRECT_CHAIN_LONG": "زنجیره تغییر مسیر بیش از حد طولانی است",
    "MIXED_CONTENT_ASSETS": "بارگذاری منابع ناامن HTTP در صفحه HTTPS شناسایی شد",
    "EXCESSIVE_RESOURCES": "تعداد بیش از حد اسکریپت یا فایل در صفحه وجود دارد",
    "SCHEMA_SYNTAX_INVALID": "ساختار داده‌های اسکیما (Schema.org) نامعتبر است",
    "SCHEMA_MISSING_REQUIRED": "ویژگی‌های الزامی داده‌های ساختاریافته وجود ندارد",
    "STRUCTURED_DATA_ABSENT": "صفحه فاقد داده‌های ساختاریافته اسکیما است",
    "HREFLANG_NO_SELF_REFERENCE": "تگ hreflang فاقد ارجاع به صفحه جاری است",
    "HREFLANG_INVALID_CODE": "کد زبان در تگ hreflang معتبر نیست",
    "HSTS_MISSING": "هدر امنیتی HSTS در پاسخ سرور وجود ندارد",
    "SECURITY_HEADERS_MISSING": "هدرهای امنیتی دفاعی تنظیم نشده‌اند",
    "CACHE_CONTROL_MISSING": "سیاست کش هدر Cache-Control وجود ندارد",
    "RENDER_BLOCKING_RESOURCES": "اسکریپت‌های مسدودکننده رندر در صفحه شناسایی شد",
    "IMAGE_DIMENSIONS_MISSING": "تصاویر فاقد ابعاد مشخص (عامل افت CLS) هستند",
    "DEAD_END_PAGE": "صفحه بن‌بست لینک داخلی شناسایی شد (اتلاف اعتبار صفحه)",
    "GENERIC_ANCHOR_TEXT": "انکرتکست نامفهوم یا عمومی در لینک‌های داخلی شناسایی شد",
    "DEEP_CLICK_DEPTH": "عمق دسترسی صفحه بیش از حد زیاد است (بیش از ۳ کلیک)",
    "KEYWORD_STUFFING": "تکرار بیش از حد کلمات کلیدی (Keyword Stuffing) شناسایی شد",
    "CONTENT_LONG_SENTENCES": "خوانایی متن پایین است (تعداد زیاد جملات طولانی)",
    "THIN_CONTENT": "محتوای بسیار کم و سطحی (Thin Content) شناسایی شد",
    "DUPLICATE_TITLE_TAG": "عنوان صفحه (Title) تکراری است و باعث تداخل رتبه (Cannibalization) می‌شود",
}
DESCRIPTION = "قانون قطعی {code} بر اساس شواهد ذخیره‌شده خزش فعال شد. قبل از هر تغییر، مدرک صفحه را بررسی کنید."


def title_of(code: Column) -> Column:
    """Title of a code; one without a title reads as its words."""
    known = F.create_map(*[F.lit(x) for pair in TITLES.items() for x in pair])
    return F.coalesce(F.element_at(known, code), F.translate(code, "_", " "))


def description_of(code: Column) -> Column:
    return F.replace(F.lit(DESCRIPTION), F.lit("{code}"), code)


def with_texts(issues: DataFrame) -> DataFrame:
    """Issues with title and description."""
    return issues.withColumns({"title": title_of(F.col("code")), "description": description_of(F.col("code"))})
