"""The wording of every message, audit entry and finding.

These texts must read exactly as the tool being replaced words them, so they
are kept here together, in the order they are produced, as plain format
strings. Operators fill them with ``str.format``; nothing else lives here.
"""

import re


def printf(template: str) -> str:
    """The same text as a ``format_string`` pattern: ``{x:.2f}`` → ``%.2f``,
    ``{x:d}`` → ``%d``, ``{x}`` → ``%s`` (for Spark-side formatting)."""
    out = template.replace("%", "%%")
    out = re.sub(r"\{\w+:([^}]+)\}", lambda m: "%" + m.group(1), out)
    return re.sub(r"\{\w+\}", "%s", out)


# Validation issues (V1–V5).
ISSUE_MIN_ROWS = "Too few rows: {rows} rows (less than {limit})."
ISSUE_MIN_COLS = "Too few columns: {cols} columns (need at least {limit})."
ISSUE_ALL_NULL = "Columns with all nulls: [{names}]"
ISSUE_DUPLICATES = "Found {n} duplicate rows."
ISSUE_CARDINALITY = "Column '{column}' has very high cardinality (unique ≈ rows)."

# Cleaning audit.
FILL_MODE = "Filled with mode: {value}"
FILL_UNKNOWN = "Filled with 'Unknown'"
FILL_MEDIAN = "Filled with median: {value:.2f}"
DUPLICATES_REMOVED = "Removed duplicate rows"
CAPPED = "Capped {n} outliers"
TO_NUMERIC = "Converted to numeric"
TO_DATETIME = "Converted to datetime"
KEPT = "Kept as categorical"

# Target candidates (G1).
TARGET_BY_NAME = "Common target variable naming pattern"
TARGET_BY_CLASSES = "Categorical variable with {n} unique values (potential classification target)"
TARGET_BY_RANGE = "Numeric variable with range {lo:.2f} to {hi:.2f} (potential regression target)"

# Distribution findings.
N1_HEAD = "Distribution Analysis for {column}:"
N1_MEAN_STD = "Mean: {mean:.2f}, Standard Deviation: {std:.2f}"
N1_SKEWED = "Distribution is {side}-skewed (skewness: {skew:.2f})"
N1_NORMAL = "Distribution is approximately normal (skewness: {skew:.2f})"
N1_TAILS = "Distribution has {kind} tails (kurtosis: {kurt:.2f})"
N1_OUTLIERS = "{n} outliers detected ({pct:.1f}% of data)"
N1_UNIQUE = "{n} unique categories"
N1_TOP = "Most common: '{value}' ({pct:.1f}% of data)"
N1_IMBALANCE = "High concentration in one category - potential class imbalance"
N1_SPREAD = "Well-distributed categories - good for analysis"

# Correlation findings.
N2_HEAD = "Correlation Analysis Insights:"
N2_STRONG = "{n} strong correlations found (|r| > 0.7)"
N2_PAIR = "  - {pair}: r = {r:.3f}"
N2_STRONG_NOTE = "Strong correlations may indicate multicollinearity"
N2_MODERATE = "{n} moderate correlations found (0.3 < |r| < 0.7)"
N2_MODERATE_NOTE = "Moderate correlations suggest interesting relationships to explore"
N2_NONE = "No significant correlations found - variables appear independent"

# Bivariate findings.
N3_HEAD = "Bivariate Analysis: {a} vs {b}"
N3_PEARSON = "Pearson correlation: r = {r:.3f}"
N3_STRENGTH = "Correlation strength: {strength}"
N3_P = "Statistical significance: p = {p:.3f}"
N3_REL_SIG = "Statistically significant relationship (p < 0.05)"
N3_REL_NOT = "No statistically significant relationship (p ≥ 0.05)"
N3_LINEAR_STRONG = "Strong linear relationship - good for predictive modeling"
N3_LINEAR_MODERATE = "Moderate linear relationship - worth investigating further"
N3_LINEAR_WEAK = "Weak linear relationship - may need non-linear analysis"
N3_CHI2 = "Chi-square statistic: {chi2:.3f}"
N3_ASSOCIATION = "Association strength: {strength}"
N3_ASSOC_SIG = "Statistically significant association (p < 0.05)"
N3_ASSOC_NOT = "No statistically significant association (p ≥ 0.05)"
N3_ANOVA = "ANOVA F-statistic: {f:.3f}"
N3_ANOVA_UNDEFINED = "ANOVA F-statistic: undefined"
N3_GROUPS_SIG = "Statistically significant difference between groups (p < 0.05)"
N3_GROUPS_NOT = "No statistically significant difference between groups (p ≥ 0.05)"

# Target findings (N4), numeric target by text feature.
N4_HEAD = "Target Variable Impact Analysis: {feature} → {target}"
N4_NC_P1 = "Pointer 1: Statistical Impact on Target Variable"
N4_NC_IMPACT = "{feature} shows significant impact on {target}"
N4_NC_BEST = "Best performing category: {category} (mean: {mean:.2f})"
N4_NC_WORST = "Worst performing category: {category} (mean: {mean:.2f})"
N4_NC_RANGE = "Impact range: {range:.2f} units difference"
N4_NC_HIGH = "High impact: Range exceeds average variability ({std:.2f})"
N4_NC_MODERATE = "Moderate impact: Range within normal variability"
N4_NC_P2 = "Pointer 2: Strategic Implications for Target Variable"
N4_NC_STABLE = "Most stable category: {category} (lowest variability)"
N4_NC_UNSTABLE = "Least stable category: {category} (highest variability)"
N4_NC_SMALL = "Warning: Some categories have small sample sizes (min: {n})"
N4_NC_GOOD = "Good sample sizes: All categories have adequate data (min: {n})"
N4_NC_ACTION = "Action: Focus on improving {category} category performance"
N4_NC_OPPORTUNITY = "Opportunity: {category} category shows best practices to replicate"
N4_NC_OBSERVATION = "Observation: {feature} has moderate influence on {target}"
N4_NC_NEXT = "Next step: Investigate other factors for stronger impact"
# ... text target by numeric feature
N4_CN_P1 = "Pointer 1: Feature Distribution Impact on Target Variable"
N4_CN_VARIES = "{feature} varies significantly across {target} categories"
N4_CN_HIGHEST = "Highest feature values: {category} (mean: {mean:.2f})"
N4_CN_LOWEST = "Lowest feature values: {category} (mean: {mean:.2f})"
N4_CN_RANGE = "Feature range: {range:.2f} units difference"
N4_CN_P2 = "Pointer 2: Predictive Power and Decision Thresholds"
N4_CN_D = "Separation strength: {d:.2f} (Cohen's d)"
N4_CN_STRONG = "Strong separation: Feature is highly predictive"
N4_CN_MODERATE = "Moderate separation: Feature has good predictive power"
N4_CN_WEAK = "Weak separation: Feature has limited predictive power"
N4_CN_THRESHOLD = "Suggested threshold: {t:.2f} for classification"
N4_CN_MULTI = "Multi-class analysis: {n} target categories"
N4_CN_DISCRIMINATION = "Feature discrimination: {range:.2f} range across categories"
N4_CN_HIGH = "High discrimination: Feature strongly differentiates target categories"
N4_CN_SOME = "Moderate discrimination: Feature provides some differentiation"
# ... text target by text feature
N4_CC_P1 = "Pointer 1: Association Strength Between Variables"
N4_CC_CHI2 = "Chi-square statistic: {chi2:.3f}"
N4_CC_P = "P-value: {p:.3f}"
N4_CC_DOF = "Degrees of freedom: {dof}"
N4_CC_VERY_STRONG = "Very strong association: Highly significant relationship"
N4_CC_STRONG = "Strong association: Statistically significant relationship"
N4_CC_WEAK = "Weak association: No significant relationship"
N4_CC_P2 = "Pointer 2: Practical Implications for Target Variable"
N4_CC_RANGE = "Association strength range: {lo:.2f} to {hi:.2f} (standardized residuals)"
N4_CC_PATTERN_STRONG = "Strong patterns: Some feature-target combinations are highly over-represented"
N4_CC_PATTERN_MODERATE = "Moderate patterns: Some feature-target combinations show notable associations"
N4_CC_PATTERN_WEAK = "Weak patterns: Feature-target combinations are mostly random"
N4_CC_SMALL = "Warning: Some cells have small counts (min: {n}) - results may be unreliable"
N4_CC_GOOD = "Good sample sizes: All combinations have adequate data"
# ... numeric target by numeric feature
N4_NN_P1 = "Pointer 1: Linear Relationship Strength"
N4_NN_R = "Correlation coefficient: {r:.3f}"
N4_NN_RELATION = "Relationship: {strength} {direction} linear relationship"
N4_NN_HIGH = "High predictive power: Feature strongly predicts target variable"
N4_NN_MODERATE = "Moderate predictive power: Feature has some predictive value"
N4_NN_LOW = "Low predictive power: Feature has limited linear relationship"
N4_NN_P2 = "Pointer 2: Strategic Implications and Next Steps"
N4_NN_DRIVER = "Action: {feature} is a key driver of {target}"
N4_NN_INCREASE = "Strategy: Increase {feature} to improve {target}"
N4_NN_DECREASE = "Strategy: Decrease {feature} to improve {target}"
N4_NN_LIMITED = "Investigation: {feature} has limited direct impact on {target}"
N4_NN_NONLINEAR = "Next step: Consider non-linear relationships or interaction effects"
N4_NN_EXPLAINED = "Explained variance: {r2:.1%} of {target} variance explained by {feature}"
N4_NN_EXPLAIN_HIGH = "High explanatory power: Feature accounts for majority of target variation"
N4_NN_EXPLAIN_MODERATE = "Moderate explanatory power: Feature explains significant portion of target variation"
N4_NN_EXPLAIN_LOW = "Low explanatory power: Feature explains limited target variation"

# Dataset findings.
N5_MISSING_ALERT = "Data Quality Alert: {pct:.1f}% of values are missing, indicating potential data collection issues."
N5_MISSING_SOME = "Data Quality: {pct:.1f}% missing values detected, consider imputation strategies."
N5_MISSING_LOW = "Data Quality: Excellent data completeness with only {pct:.1f}% missing values."
N5_TARGET = "Target Variable Analysis: {target} is {kind} with {n} unique values."
N5_TARGET_STATS = "Target Statistics: Mean = {mean:.2f}, Std = {std:.2f}"
N5_TARGET_MODE = "Target Distribution: Most common value is '{value}'"
N5_NUMERIC = "Numeric Analysis: {n} numeric variables available for statistical analysis."
N5_SKEW = "Distribution Alert: {column} shows {side} skewness ({skew:.2f}), indicating non-normal distribution."
N5_CATEGORICAL = "Categorical Analysis: {n} categorical variables with varying cardinality levels."
N5_CARDINALITY = ("High Cardinality: {column} has {n} unique values ({pct:.1f}% of rows), "
                  "consider grouping or feature engineering.")
N5_STRONG = ("Strong Relationships: {n} variable pairs show strong correlation (|r| > 0.7), "
             "indicating potential multicollinearity.")
N5_MODERATE = ("Moderate Relationships: {n} variable pairs show moderate correlation (0.3 < |r| < 0.7), "
               "suggesting interesting patterns to explore.")
N5_TARGET_FOCUS = ("Target-Focused Analysis: With {target} as the target variable, focus on identifying key "
                   "drivers and predictive patterns for better outcomes.")
N5_BUSINESS = ("Business Impact: Dataset contains {rows} records across {cols} dimensions, "
               "suitable for comprehensive analysis and modeling.")
N5_ITEM = "{i}. {text}"

# Executive summary.
N6_TITLE = "Executive Summary"
N6_SIZE = "Your dataset contains {rows:,} records across {cols} variables."
N6_FOCUS = "The analysis focuses on {target} as the target variable, helping identify key patterns and relationships."
N6_EXPLORE = "This is a comprehensive exploratory analysis to understand data patterns and relationships."
N6_QUALITY = "Data Quality Assessment"
N6_QUALITY_EXCELLENT = "Excellent Data Quality: Less than 5% missing values"
N6_QUALITY_GOOD = "Good Data Quality: Some missing values present but manageable"
N6_QUALITY_POOR = "Data Quality Concerns: High percentage of missing values detected"
N6_MISSING = "Missing Values: {pct:.1f}% of all data points"
N6_DUPLICATES = "Duplicate Rows: {n:,} records"
N6_MEMORY = "Memory Usage: {mb:.2f} MB"
N6_VARIABLES = "Variable Overview"
N6_NUMERIC_COUNT = "Numeric Variables: {n} columns for statistical analysis"
N6_CATEGORICAL_COUNT = "Categorical Variables: {n} columns for grouping and classification"
N6_KEY_NUMERIC = "  - Key numeric variables: {names}{more}"
N6_KEY_CATEGORICAL = "  - Key categorical variables: {names}{more}"
N6_TARGET = "Target Variable Analysis: {target}"
N6_TYPE = "Type: {kind}"
N6_UNIQUE = "Unique Values: {n:,}"
N6_RANGE = "Range: {lo:.2f} to {hi:.2f}"
N6_AVERAGE = "Average: {mean:.2f} (±{std:.2f})"
N6_SKEWED = "Distribution: {side}-skewed (non-normal)"
N6_NORMAL = "Distribution: Approximately normal"
N6_MOST_COMMON = "Most Common: '{value}' ({pct:.1f}% of data)"
N6_IMBALANCE = "Class Imbalance: One category dominates the data"
N6_BALANCED = "Balanced Distribution: Good variety across categories"
N6_FINDINGS = "Key Statistical Findings"
N6_NUMERIC = "Numeric Variables"
N6_NUMERIC_LINE = "{column}: Average = {mean:.2f}, Variability = {std:.2f}"
N6_CATEGORICAL = "Categorical Variables"
N6_CATEGORICAL_LINE = "{column}: {n} categories, most common: '{value}'"
N6_RELATIONS = "Relationship Analysis"
N6_STRONG = "Strong Relationships Found: {n} variable pairs show strong correlation"
N6_MODERATE = "Moderate Relationships: {n} variable pairs show moderate correlation"
N6_PAIR = "  - {pair}: r = {r:.3f}"
N6_INDEPENDENT = "Independent Variables: No strong correlations found - variables appear independent"
N6_TARGET_INSIGHTS = "Target-Focused Insights for {target}"
N6_TOP_FEATURES = "Top Features Affecting Target Variable:"
N6_FEATURE_CORR = "{rank}. {feature}: Correlation = {value:.3f}"
N6_FEATURE_RANGE = "{rank}. {feature}: Range effect = {value:.2f}"
N6_RECOMMENDATIONS = "Recommendations"
N6_COLLECT = "Data Collection: Address missing data issues before modeling"
N6_MODELING = "Modeling Focus: Use {target} as target for predictive modeling"
N6_PREDICTOR = "Key Predictor: {feature} shows strongest relationship with target"
N6_MULTICOLLINEARITY = "Multicollinearity: Consider feature selection to address highly correlated variables"
N6_MIXED = "Mixed Analysis: Combine numeric and categorical approaches for comprehensive insights"
N6_NEXT = "Next Steps: Consider advanced modeling techniques based on your specific goals"
N6_ACTIONS = "Quick Action Items"
N6_ACTION_1 = "1. Review Data Quality: Check the data quality assessment above"
N6_ACTION_2 = "2. Explore Relationships: Use the correlation analysis to identify key patterns"
N6_ACTION_3 = "3. Focus on Target: Analyze how other variables relate to {target}"
N6_ACTION_4 = "4. Generate Visualizations: Use the advanced visualization tabs for deeper insights"
N6_ACTION_5 = "5. Export Results: Download the summary and statistics for further analysis"

# One-paragraph summary.
N7_SIZE = "The dataset has {rows} rows and {cols} columns. "
N7_MISSING = "Columns with missing values: {items}. "
N7_TOP = "Top values for {column}: {items}. "
N7_ITEM = "{name}({n})"
