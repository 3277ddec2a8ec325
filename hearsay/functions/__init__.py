"""functions of the review-analytics engine."""
