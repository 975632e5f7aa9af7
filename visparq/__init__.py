"""Visual and document evidence as Spark programs: pixels, contrast, reconciliation, HTML, JSON, trees and stateful streams."""
