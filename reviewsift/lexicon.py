"""Term lists and patterns used by the rubric and reason-code jobs.

A lexicon is plain data: pass another :class:`Lexicon` (or a `lexicon(category, term)` table
through :func:`from_table`) to score reviews in another language.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

# ---------------------------------------------------------------------------
# The Vietnamese term lists and patterns of the labelling rubric.
# ---------------------------------------------------------------------------
GENERIC_PHRASES = (
    "tốt", "tot", "ok", "okay", "hay", "đẹp", "ngon", "thơm", "ổn", "tạm được", "bình thường",
    "rất tốt", "quá tốt", "tuyệt vời", "ưng ý", "hài lòng", "rất hài lòng", "cực kì hài lòng",
    "cực kỳ hài lòng", "sản phẩm tốt", "sp tốt", "chất lượng tốt", "đáng tiền", "năm sao",
    "5 sao",
)
GENERIC_WORDS = (
    "tốt", "rất", "quá", "ok", "hay", "đẹp", "ngon", "thơm", "ổn", "hài", "lòng", "ưng", "ý",
    "sản", "phẩm", "sp", "shop",
)
ATTRIBUTES = (
    "pin", "sạc", "âm thanh", "loa", "mic", "màn hình", "camera", "chất liệu", "vải", "size",
    "kích thước", "mùi", "vị", "ngọt", "cay", "đắng", "mỏng", "dày", "nặng", "nhẹ", "rộng",
    "chật", "nóng", "mát", "êm", "ồn", "rè", "bền", "độ bền", "hiệu năng", "tốc độ", "nguồn",
    "nắp", "dây", "khóa", "đường may", "màu", "hình ảnh", "nội dung", "cốt truyện", "bản dịch",
    "giấy", "da", "tóc", "dạ dày", "bao bì", "hộp", "chai", "tem", "hạn sử dụng", "hút",
    "độ hút", "tác dụng", "chất lượng", "hoạt động", "độ chính xác", "độ nhạy", "khả năng",
)
EXPERIENCE = (
    "mình dùng", "tôi dùng", "đã dùng", "sử dụng", "dùng được", "mua về", "mặc", "uống", "ăn",
    "đọc", "thử", "trải nghiệm", "sau khi", "nhận hàng", "lắp", "giặt", "sạc", "chạy",
)
DECISION = (
    "phù hợp", "không hợp", "nên", "không nên", "cân nhắc", "so với", "rẻ hơn", "đắt hơn",
    "hời hơn", "giống", "khác", "ưu điểm", "nhược điểm", "nhưng", "tuy nhiên", "lỗi", "hỏng",
    "không hoạt động", "không lên nguồn", "sai mẫu", "thiếu", "bị móp", "bị vỡ", "bị chảy",
    "bị cong", "bị gập", "móp méo", "yếu", "không vừa", "vừa vặn", "không đúng", "đúng mô tả",
    "đúng hãng",
)
SHIPPING = (
    "giao hàng", "shipper", "giao nhanh", "giao chậm", "đóng gói", "shop", "phục vụ", "tư vấn",
)
DEFECTS = (
    "lỗi", "hỏng", "bể", "vỡ", "móp", "móp méo", "cong", "gập", "rách", "rè", "yếu",
    "không hoạt động", "không lên nguồn", "sai mẫu", "không đúng", "thiếu", "chảy", "tụt pin",
)
SELLER = ("shop",)
SPAM = ("nhận xu", "đánh giá nhận xu", "ủng hộ shop", "mua ngay")
COMPARISON = ("so với", "rẻ hơn", "đắt hơn", "hời hơn", "giống loại")
SIZE_FIT = ("size", "kích thước", "rộng", "chật", "dài", "ngắn")
DURABILITY = ("độ bền", "bền", "dùng lâu", "lâu dài")
PACKAGING = ("đóng gói", "bao bì", "hộp", "móp")
NUMBER_UNITS = (
    "phút", "giờ", "ngày", "tuần", "tháng", "lần", "cm", "mm", "kg", "g", "ml", "mah", "%",
)

# Terms of the flag refinement pass.
REFINE_DEFECTS = (
    "lỗi", "hỏng", "bể", "vỡ", "móp", "chảy", "rè", "không lên", "không hoạt động", "tụt pin",
    "nóng", "rách", "sai mẫu", "thiếu",
)
REFINE_DURABILITY = (
    "độ bền", "bền", "sau một tháng", "sau 1 tháng", "dùng lâu", "lâu dài", "thời gian dài",
)
REFINE_COMPARISON = ("so với", "hơn loại", "rẻ hơn", "hời hơn", "giống loại")

# Terms of the reason codes.
FEATURE_WORDS = (
    "pin", "mic", "âm thanh", "màn hình", "camera", "mùi", "vị", "chất liệu", "kích thước",
    "độ bền", "đóng gói", "giao hàng", "hiệu năng", "giá",
)
PROS = ("tốt", "ổn", "rõ", "nhanh", "đẹp", "êm", "tiện", "ưu điểm")
CONS = ("nhưng", "tuy nhiên", "hơi", "kém", "rè", "chậm", "nhược điểm")
QUANTITY_UNITS = (
    "ngày", "tuần", "tháng", "giờ", "phút", "lần", "km", "mah", "gb", "cm", "%",
)

# Stop words of the word-frequency report.
STOP_WORDS = (
    "và", "là", "của", "có", "cho", "được", "mình", "tôi", "thì", "mà", "rất", "quá", "này",
    "đó", "với", "khi", "đã", "cũng", "không", "ko", "k", "nhưng", "nên", "ở", "về", "một",
    "như", "cái", "các", "để", "sản", "phẩm", "sp", "shop", "tiki", "hàng", "ạ", "nha", "nhé",
)


@dataclass(frozen=True)
class Lexicon:
    """Term lists by category; every term is matched as a substring."""

    generic_phrases: tuple[str, ...] = GENERIC_PHRASES
    generic_words: tuple[str, ...] = GENERIC_WORDS
    attributes: tuple[str, ...] = ATTRIBUTES
    experience: tuple[str, ...] = EXPERIENCE
    decision: tuple[str, ...] = DECISION
    shipping: tuple[str, ...] = SHIPPING
    defects: tuple[str, ...] = DEFECTS
    seller: tuple[str, ...] = SELLER
    spam: tuple[str, ...] = SPAM
    comparison: tuple[str, ...] = COMPARISON
    size_fit: tuple[str, ...] = SIZE_FIT
    durability: tuple[str, ...] = DURABILITY
    packaging: tuple[str, ...] = PACKAGING
    number_units: tuple[str, ...] = NUMBER_UNITS
    refine_defects: tuple[str, ...] = REFINE_DEFECTS
    refine_durability: tuple[str, ...] = REFINE_DURABILITY
    refine_comparison: tuple[str, ...] = REFINE_COMPARISON
    feature_words: tuple[str, ...] = FEATURE_WORDS
    pros: tuple[str, ...] = PROS
    cons: tuple[str, ...] = CONS
    quantity_units: tuple[str, ...] = QUANTITY_UNITS
    stop_words: tuple[str, ...] = STOP_WORDS

    def with_terms(self, **lists) -> "Lexicon":
        return replace(self, **{name: tuple(terms) for name, terms in lists.items()})


VIETNAMESE = Lexicon()

def from_table(
    terms: DataFrame, base: Lexicon = VIETNAMESE, max_terms: int = 5_000
) -> Lexicon:
    """Read a `lexicon(category, term)` table into a :class:`Lexicon`.

    The terms become literals of the scoring expressions, so their number is bounded by
    ``max_terms``; a larger table raises. A caller with a larger lexicon raises the bound and
    pays with longer planning; the plan is the same at every size.
    """
    rows = terms.select("category", "term").limit(max_terms + 1).collect()
    if len(rows) > max_terms:
        raise ValueError(f"More than {max_terms} terms; raise max_terms to accept them")
    lists: dict[str, list[str]] = {}
    for row in rows:
        lists.setdefault(row["category"], []).append(row["term"])
    return base.with_terms(**lists)


# ---------------------------------------------------------------------------
# Pattern families of the second rubric, matched on lower-case text.
# ---------------------------------------------------------------------------
V2_SPECIFIC_STRONG = (
    r"\d+\s*(ngày|tuần|tháng|năm|giờ|phút|lần)",
    r"\d+\s*(cm|mm|kg|g|ml|l|w|mah|gb|mb|k|đ)",
    r"(pin|battery).{0,30}\d",
    r"(size|cỡ|số).{0,20}(nhỏ|lớn|vừa|chật|rộng|\d)",
    r"(mùi|màu|chất|vị|độ).{0,30}(thơm|ngọt|chua|đắng|thô|mỏng|dày|bền|mịn)",
    r"(lỗi|hỏng|vỡ|nứt|bong|tróc|cháy|chập|chảy|rò|đứt|kêu tiếng)",
    r"(không dùng được|không hoạt động|không nhận|không kết nối|không chín)",
    r"(so với|hơn so với|kém hơn|tốt hơn)",
    r"(kiềm dầu|ẩm mịn|lên tone|chống trôi|thấm nhanh|bết rít|cay mắt|kích ứng|táo bón|dị ứng)",
    r"(nút giữa|lực bấm|độ nhạy|đàn hồi|tiếng ồn|lag|treo máy|nóng máy)",
    r"(tã.{0,20}(thoáng|hăm|thấm|rò))",
    r"(in hơi ẩu|bìa nhoè|giấy dày|giấy mỏng|mực in|in rõ|in sạch)",
    r"(60w|90w|usb-c|type-c|hdmi|wifi|bluetooth)",
    r"(nội dung|nhân vật|tác giả|phong cách|văn phong|cốt truyện|tình tiết).{0,40}"
    r"(hay|tốt|kém|sáo|chân thực|sinh động|nhân văn|kỳ ảo|cảm động)",
    r"(thoáng|hăm|thấm hút|rò rỉ|co giãn|đàn hồi)",
    r"(lực hút|khí thổi|lọc|không lọc|tín hiệu|kết nối)",
    r"(kêu tạch tạch|kêu to|kêu nhỏ|ồn|êm|tiếng động)",
    r"(bật chạy|chạy êm|chạy ồn|chạy nóng)",
    r"(thiếu.{0,20}(số lượng|hàng|sản phẩm|phụ kiện|quà))",
    r"(giao sai|nhầm hàng|sai size|sai mẫu|sai màu)",
    r"(mỏng.{0,15}nhưng|dày.{0,15}nhưng|nhẹ.{0,15}nhưng)",
    r"(cảm nhận.{0,30}(da|mùi|vị|chất|màu))",
    r"(dính|nhớt|bết|trơn|nhám|sần|mịn).{0,10}(tay|da|mặt)",
)
V2_SPECIFIC_MEDIUM = (
    r"(pin yếu|pin lâu|sạc nhanh|sạc chậm|pin chậm)",
    r"(vải mỏng|vải dày|co giãn|chất liệu)",
    r"(thấm hút|không thấm|chống nước|chống bụi)",
    r"(sáng da|căng da|mờ tàn nhang|dưỡng ẩm)",
    r"(không bị rơi|không vỡ|chắc chắn|độ bền)",
    r"(phù hợp.{0,20}(tuổi|người|gia đình|trẻ|bé|sinh viên|học sinh|văn phòng))",
    r"(đọc.{0,30}(hay|tốt|dễ hiểu|khó hiểu|nhàm|cuốn|kém))",
    r"(ngôn từ|câu chuyện|bài học|nội dung).{0,30}(hay|tốt|sáo|bình thường|đặc biệt)",
    r"(in rõ|in đẹp|giấy ổn|sách đẹp|bìa đẹp)",
    r"(chất.{0,10}(kem|sữa|serum|toner|dầu).{0,20}(lỏng|đặc|mịn|nhớt|loãng))",
    r"(ko vừa|không vừa|hơi chật|hơi rộng)",
    r"(tốt cho.{0,20}(dạ dày|da|tóc|xương|khớp|tiêu hóa|đề kháng))",
    r"(cứng|mềm|nhẹ|nặng).{0,20}(hơn|quá|tương đối)",
    r"(nấu nhanh|cơm dẻo|cơm ngon|không dính)",
)
V2_NOT_USED_YET = (
    r"(chưa dùng|chưa đọc|chưa xài|chưa sử dụng|mới nhận|mới mua chưa|chưa biết đánh giá)"
)
V2_EXPERIENCE = (
    r"(mình|tôi|tui|mik|mk|em|bé|con|gia đình).{0,50}(dùng|xài|sử dụng|uống|mặc|đọc|ăn)",
    r"(đã|mới).{0,10}(dùng|xài|sử dụng|uống|mặc|đọc)",
    r"(sau|được).{0,20}(dùng|xài).{0,30}(thấy|cảm|nhận|thì)",
    r"(lần \d+|hộp \d+|tuýp \d+|chai \d+).{0,20}(rồi|dùng)",
    r"(bé|con).{0,30}(uống|dùng|thích|ăn)",
    r"(thấy|cảm nhận|nhận thấy).{0,50}(tốt|ok|ổn|hay|đẹp|ngon|thơm|mịn|nhanh|chậm|rõ)",
    r"(mặc.{0,20}(mát|ấm|thoải mái|vừa|chật|rộng))",
    r"(đọc.{0,40}(xong|được|rồi|nhiều lần|đi đọc lại))",
    r"(mua.{0,20}(về|rồi).{0,20}(thấy|cảm|nhận|bật|dùng|xài|ăn|mặc|đọc))",
    r"(bật chạy|bật lên|cắm vào|cắm điện|khi dùng|lúc dùng)",
    r"(sau \d+.{0,10}(dùng|xài|sử dụng|sử dụng))",
    r"(nhận hàng.{0,30}(thấy|mở ra|kiểm tra|dùng thử))",
    r"(mua về.{0,30}(thấy|mở|thử|dùng|xài))",
)
V2_DECISION_STRONG = (
    r"(không nên|cẩn thận|lưu ý|chú ý|cảnh báo|nên biết)",
    r"(so với|so sánh|hơn|kém hơn).{0,30}(loại|sản phẩm|hàng|chai|mẫu)",
    r"(phù hợp với|dành cho|không hợp|không phù hợp)",
    r"(lỗi|hỏng|vỡ|không hoạt động|không dùng được|không nhận)",
    r"(size|cỡ).{0,30}(nhỏ hơn|lớn hơn|chật|rộng|sai)",
    r"(tác dụng phụ|nhược điểm|điểm trừ|hạn chế)",
    r"(giao sai|thiếu hàng|không đủ số lượng|thiếu món)",
    r"(giá rẻ hơn|đắt hơn|hời hơn).{0,30}(siêu thị|cửa hàng|hiệu|shop|ngoài)",
    r"(tả cứng|tả mềm|không khác gì quảng cáo|không đúng như)",
    r"(không thể duy trì|không cấp ẩm|không kiềm dầu)",
)
V2_DECISION_MEDIUM = (
    r"(tốt|ngon|đẹp|ổn).{0,20}(nhưng|tuy nhiên|ngoại trừ|mặc dù)",
    r"(ưu điểm|điểm cộng|hay ở chỗ)",
    r"(pin|sạc).{0,30}(tốt|lâu|nhanh|yếu|chậm)",
    r"(chất liệu|vải|da|nhựa|kim loại).{0,20}(mỏng|dày|bền|đẹp|xấu)",
)
V2_SPAM = (
    r"(nhận xu|lấy xu|lấy điểm|điểm thưởng).{0,30}(đánh giá|review)",
    r"(liên hệ|inbox|nhắn tin|zalo).{0,20}(mình|em|shop)",
    r"anh chị nào.{0,30}(liên hệ|inbox|cần)",
    r"(mua ngay đi|siêu phẩm số 1)",
)
V2_ONLY_PUNCTUATION = r"^[.…\s!?*]+$"
V2_FLAG_PATTERNS = {
    "shipping": r"(giao hàng|ship|vận chuyển|shipper|đóng gói)",
    "product": r"(sản phẩm|sp\b|chất lượng|pin|vải|chất|màu|size|mùi|vị|da|tóc|lông|bé|con)",
    "seller": r"(shop\b|cửa hàng|nhân viên|phục vụ|dịch vụ|tiki\b)",
    "contains_product_defect": r"(lỗi|hỏng|vỡ|nứt|bong|tróc|cháy|chập|chảy|rò rỉ|đứt|"
    r"không hoạt động|không nhận|không kết nối|máy đứng|đứng lun)",
    "contains_usage_context": r"(phù hợp|dùng cho|dành cho|mùa hè|mùa đông|mùa lạnh|ngủ|học|"
    r"văn phòng|trẻ nhỏ|bé|ngoài trời)",
    "contains_comparison": r"(so với|hơn so với|so sánh|kém hơn|tốt hơn|khác với|không giống|"
    r"tương tự)",
    "contains_size_fit_info": r"(size|cỡ|số đo|vừa|chật|rộng|dài|ngắn).{0,20}"
    r"(mặc|mua|đặt|giao|đo)",
    "contains_durability_info": r"(bền|độ bền|sau \d+ (tháng|năm|tuần)|dùng \d+ (tháng|năm))",
    "contains_packaging_info": r"(hộp bị|sách bị|bao bì cũ|móp|méo|bẩn|rách|ướt).{0,60}"
    r"(sản phẩm|hàng|chai|sp|sách)",
    "possible_fake_or_spam": r"(nhận xu|lấy xu|inbox|liên hệ em|anh chị nào cần)",
}
V2_INFORMATIVE_FLAGS = (
    "contains_product_defect", "contains_usage_context", "contains_comparison",
    "contains_size_fit_info", "contains_durability_info", "contains_packaging_info",
)
V2_EMPTY_FLAGS = ("generic_only", "shipping_only", "seller_service_only")


@dataclass(frozen=True)
class PatternSet:
    """Regex families of the second rubric; replaceable as a whole."""

    specific_strong: tuple[str, ...] = V2_SPECIFIC_STRONG
    specific_medium: tuple[str, ...] = V2_SPECIFIC_MEDIUM
    not_used_yet: str = V2_NOT_USED_YET
    experience: tuple[str, ...] = V2_EXPERIENCE
    decision_strong: tuple[str, ...] = V2_DECISION_STRONG
    decision_medium: tuple[str, ...] = V2_DECISION_MEDIUM
    spam: tuple[str, ...] = V2_SPAM
    flags: tuple[tuple[str, str], ...] = tuple(V2_FLAG_PATTERNS.items())

    def every(self) -> list[str]:
        """All patterns of the set."""
        families = (
            self.specific_strong, self.specific_medium, self.experience, self.decision_strong,
            self.decision_medium, self.spam,
        )
        singles = [self.not_used_yet, *(pattern for _, pattern in self.flags)]
        return [p for family in families for p in family] + singles


VIETNAMESE_PATTERNS = PatternSet()
