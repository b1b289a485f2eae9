"""Message catalogues of the label reasons and explanations (our own wording; replaceable)."""

from __future__ import annotations

RUBRIC_REASONS = {
    "noise": "Không có nội dung đọc được trong đánh giá.",
    "generic": "Chỉ có lời khen hoặc chê chung, không có chi tiết về sản phẩm.",
    "attributes": "Có nhắc tới đặc điểm của sản phẩm:",
    "number": "Có con số hoặc mốc thời gian cụ thể.",
    "experience": "Người viết đã tự mình sử dụng sản phẩm.",
    "decision": "Có so sánh, điều kiện hoặc điểm trừ giúp cân nhắc khi mua.",
    "defects": "Có nêu lỗi hoặc điểm yếu:",
    "shipping": "Phần lớn nói về việc giao hàng và người bán.",
    "other": "Có ít thông tin dùng được cho người mua.",
}

RUBRIC_V2_REASONS = {
    "noise_only": "Đánh giá chỉ gồm ký tự không có nghĩa.",
    "noise_repeat": "Đánh giá lặp ký tự, không cho biết gì về sản phẩm.",
    "shipping_generic": "Chỉ khen việc giao hàng, không nói về sản phẩm.",
    "shipping": "Chỉ nói về giao hàng hoặc đóng gói.",
    "seller": "Chỉ nói về người bán.",
    "generic": "Chỉ nhận xét chung, thiếu chi tiết.",
    "unhelpful": "Chưa đủ chi tiết để giúp người mua.",
    "helpful": "Có chi tiết giúp người mua.",
    "prefix": "Đánh giá",
    "suffix": "nên có ích cho người mua.",
    "contains_product_defect": "nêu lỗi của sản phẩm",
    "contains_usage_context": "nói rõ hoàn cảnh sử dụng",
    "contains_comparison": "so sánh với lựa chọn khác",
    "contains_size_fit_info": "cho biết kích cỡ",
    "contains_durability_info": "nói về độ bền",
    "contains_packaging_info": "nêu vấn đề bao bì",
    "too_short_but_specific": "ngắn mà đúng trọng tâm",
    "experience": "kể lại quá trình dùng",
    "specific": "có nhiều chi tiết",
}

EXPLANATION = {
    "reason": {
        "specific_experience": "Có số liệu hoặc thời gian sử dụng nên người mua kiểm chứng được.",
        "mentions_product_features": "Nhắc tới ít nhất hai đặc điểm của sản phẩm.",
        "mentions_pros_and_cons": "Nêu cả điểm được và điểm chưa được.",
        "sufficient_detail": "Đủ dài để hiểu người viết đã trải qua những gì.",
        "too_generic": "Quá ngắn và chung chung, chưa có dẫn chứng.",
    },
    "no_reason": "Ít dấu hiệu về chi tiết và trải nghiệm thực tế.",
    "assessment_helpful": "Đánh giá có ích cho người mua.",
    "assessment_unhelpful": "Đánh giá chưa đủ thông tin cho người mua.",
    "score_helpful": "Mô hình thấy nhiều dấu hiệu của một đánh giá có ích.",
    "score_unhelpful": "Mô hình thấy ít dấu hiệu của một đánh giá có ích.",
    "evidence": "Dấu hiệu do quy tắc tìm ra.",
    "buyer_impact": "Thêm thông tin để xét sản phẩm có hợp nhu cầu không.",
    "limitations": [
        "Thiếu hoàn cảnh sử dụng hoặc đặc điểm sản phẩm.",
        "Thiếu số liệu để kiểm chứng.",
    ],
    "missing_helpful": ["Cảm nhận sau thời gian dài sử dụng."],
    "missing_unhelpful": [
        "Đã dùng bao lâu và trong hoàn cảnh nào.",
        "Đã thử những tính năng nào.",
        "Số liệu hoặc so sánh làm căn cứ.",
    ],
    "suggestion_helpful": "Nên thêm ảnh và cảm nhận sau thời gian dài.",
    "suggestion_unhelpful": "Nên thêm thời gian dùng, tính năng đã thử, điểm được và chưa được.",
    "rewrite": "Tôi dùng [thời gian], đã thử [tính năng]: được ở [điểm], chưa được ở [điểm].",
    "buyer_value_helpful": "Giúp hình dung trải nghiệm thật.",
    "buyer_value_unhelpful": "Ít giá trị tham khảo vì khó kiểm chứng.",
    "alignment": "Phần giải thích không đổi nhãn hay điểm của mô hình.",
    "rubric_note": "Điểm tính từ các dấu hiệu của quy tắc.",
    "disclaimer": "Điểm chất lượng thông tin là điểm bổ sung, không phải xác suất của mô hình.",
    "criteria": {
        "specificity": "Mức cụ thể",
        "feature_coverage": "Số đặc điểm được nhắc tới",
        "balance": "Mức cân bằng",
        "usage_context": "Hoàn cảnh sử dụng",
        "verifiability": "Mức kiểm chứng được",
        "buyer_relevance": "Mức liên quan tới người mua",
    },
}

LABEL_INSTRUCTIONS = (
    "Gán nhãn từng đánh giá sản phẩm: 1 nếu cho người mua biết điều cụ thể, 0 nếu không. "
    "Chấm specificity 0..2, product_experience 0..2, decision_value 0..2, clarity 0..1, "
    "noise_penalty -2..0. Giữ nguyên annotation_id và trả về JSON theo mẫu."
)
EXPLAIN_INSTRUCTIONS = (
    "Giải thích kết quả của mô hình cho đánh giá dưới đây. Không đổi nhãn hay điểm; chỉ dùng "
    "thông tin có trong đánh giá; chấm sáu tiêu chí từ 0 đến 100; trả về một đối tượng JSON."
)
